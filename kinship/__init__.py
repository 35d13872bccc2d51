"""kinship: a Spark-native record-linkage and corpus engine built from DataFrame transformations."""
