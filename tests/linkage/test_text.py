"""Cleaning, tokens and keys, on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from kinship.functions import scripts, text
from kinship.operators import blocking, profiles


@pytest.fixture(scope="module")
def evaluate(spark):
    def run(column, value, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]

    return run


@pytest.mark.parametrize("given,expected", [("Café Straße", "Cafe Straße"), ("ﬁne ½", "fine 1⁄2"), ("plain", "plain"), ("सूर्या", "surya"), ("प्राइवेट लिमिटेड", "praivet limited"), ("कमल", "kamal"), ("க", "ka"), ("फ़ोन", "fon"), ("১২", "12"), ("a। b", "a  b"), ("", "")])
def test_latin(given, expected):
    assert scripts.latin(given) == expected


def test_romanized_words_join_consonants():
    assert scripts.romanize("सूर्या") == "surya"
    assert scripts.romanize("भारत") == "bharat"
    assert scripts.romanize("मित्र") == "mitra"  # a cluster keeps its vowel
    assert scripts.romanize("മലയാളം").startswith("malaya")


@pytest.mark.parametrize("given,expected", [("a1b22", ["a", "1", "b", "22"]), ("", []), ("--", []), ("foo_bar", ["foo", "bar"])])
def test_tokens(evaluate, given, expected):
    assert evaluate(text.tokens, given) == expected


def test_clean(evaluate):
    assert evaluate(text.base_clean, "Joe's & Co + A@B") == "joes  and  co  and  a b"
    assert evaluate(text.base_clean, None) == ""


@pytest.mark.parametrize("given,expected", [(["l", "l", "c"], ["llc"]), (["s", "v", "road"], ["sv", "road"]), (["a"], ["a"]), ([], []), (["x", "1", "y"], ["x", "1", "y"])])
def test_letters_are_glued(evaluate, given, expected):
    assert evaluate(text.glue_letters, given, "array<string>") == expected


@pytest.mark.parametrize("given,expected", [("parties", "party"), ("ties", "tie"), ("glass", "glass"), ("bus", "bus"), ("boxes", "boxe"), ("123s", "123"), ("1234", "1234"), ("abc", "abc")])
def test_stem(evaluate, given, expected):
    assert evaluate(text.stem, given) == expected


@pytest.mark.parametrize("given,expected", [("lakshmi", "lxm"), ("laxmi", "lxm"), ("aeio", "a"), ("123", "123"), ("", ""), ("wave", "bb"), ("school", "sl"), ("yy", "i")])
def test_skeleton(evaluate, given, expected):
    assert evaluate(text.skeleton, given) == expected


@pytest.mark.parametrize(
    "given,core,legal,extra",
    [
        ("the acme of rome inc", "acme rome", "inc", ""),
        ("svc acme grp ltd co", "acme", "co ltd", "grp svc"),
        ("inc", "inc", "inc", ""),
        ("the", "the", "", ""),
        ("grp inc", "grp", "inc", "grp"),
        ("", "", "", ""),
    ],
)
def test_ends(evaluate, given, core, legal, extra):
    got = evaluate(text.split_ends, given.split(), "array<string>")
    assert (" ".join(got.core), " ".join(got.legal), " ".join(got.extra)) == (core, legal, extra)


@pytest.mark.parametrize(
    "given,core,legal,alias",
    [
        ("Acme Robotics, Inc.", "acme robotic", "inc", ""),
        ("Foo LLC dba Bar Shops", "foo", "llc", "foo | bar shop"),
        ("www.keystone.com", "keystone", "", ""),
        ("R0dgers Hea1th Serv1ces", "rodger health servlce", "", ""),
        ("lndia Tools (P) Ltd", "india tool", "ltd pvt", ""),
        ("L.L.C. Brothers", "bro", "llc", ""),
        (None, "", "", ""),
    ],
)
def test_names(spark, given, core, legal, alias):
    got = spark.createDataFrame([(given,)], "x string").select(text.name_parts(F.col("x")).alias("y")).first()["y"]
    if core == "bro":
        assert got.legal == ["llc"] and got.core == ["bros"]
    else:
        assert (" ".join(got.core), " ".join(got.legal), got.alias) == (core, legal, alias)


@pytest.mark.parametrize(
    "given,tokens,postal,landmark",
    [
        ("No. 0012 Main Street, New York 10001-1234", "12 main st ny 10001", "10001", 0),
        ("12th Avenue, Bangalore 560 001", "12 ave bengaluru 560001", "560001", 0),
        ("10001 Main", "10001 main", "", 0),
        ("10001", "10001", "10001", 0),
        ("near Opera, 75009 Paris 75009", "nr opera 75009 paris 75009", "75009", 1),
        ("Suite 5", "ste 5", "", 0),
        (None, "", "", 0),
    ],
)
def test_addresses(spark, given, tokens, postal, landmark):
    got = spark.createDataFrame([(given,)], "x string").select(text.address_parts(F.col("x")).alias("y")).first()["y"]
    assert (" ".join(got.tokens), got.postal, got.landmark) == (tokens, postal, landmark)


def test_only_the_last_postal_number_is_dropped(spark):
    df = spark.createDataFrame([(["75009", "x", "75009", "3"], "75009")], "a array<string>, p string")
    assert df.select(text.house_numbers(F.col("a"), F.col("p"))).first()[0] == ["75009", "3"]


def test_house_number_skips_every_postal(spark):
    p = profiles.profiles(spark.createDataFrame([("S1-1", "A", "75009 x 75009 007", "fr", 1)], "entity_id string, business_name string, business_address string, country string, src int")).first()
    assert (p.house, p.house_digits, p.first_number) == (7, 1, "75009")


def test_record_keys(spark):
    df = spark.createDataFrame([(["tech", "business", "12"], "", ["5", "main", "st", "10001"], "10001")], "core array<string>, alias string, addr array<string>, postal string")
    keys = set(df.select(blocking.record_keys(*(F.col(c) for c in df.columns))).first()[0])
    assert {"ntech", "n12", "btech_business", "bbusiness_12", "kbsns", "fbusi", "gtech", "gness", "rtb", "amain", "h5|main", "h5|st", "p10001", "q5|10001"} <= keys
    assert not any(k.startswith("w") for k in keys) and {k for k in keys if k[0] == "c"} == {"ctc|10001", "cbsns|10001"} and {k for k in keys if k[0] == "d"} == {"dtc|mn", "dbsns|mn"}


def test_aliases_add_keys_and_repeat_them(spark):
    df = spark.createDataFrame([(["foo"], "foo | bar foo", [], "")], "core array<string>, alias string, addr array<string>, postal string")
    keys = df.select(blocking.record_keys(*(F.col(c) for c in df.columns))).first()[0]
    assert keys.count("nfoo") == 2 and "nbar" in keys


def test_translit_is_learned_from_true_pairs(spark):
    rows = [(f"S1-{i}", "Surya Services", "सूर्या सर्विसेज") for i in range(3)]
    got = {tuple(r) for r in profiles.learn_translit(spark.createDataFrame(rows, "s1_id string, name_s1 string, name_match string"), latin_below=1).collect()}
    assert got == {("sarvisej", "services")} and not profiles.learn_translit(spark.createDataFrame(rows[:2], "s1_id string, name_s1 string, name_match string")).collect()
