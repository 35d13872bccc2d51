"""Writes a synthetic split of noisy records: python tests/linkage/synthetic.py FOLDER [ENTITIES]. The hold-out figure in the README is of such a split."""

import os
import sys

import numpy as np

FIRST = "Blue Golden Northern Silver Rapid Sunrise Harbor Royal Green Summit Cedar Delta Lotus Orion Pioneer Crystal Maple Falcon Ocean Granite".split()
SECOND = "River Gate Light Oak Star Valley Stone Field Bridge Peak Lake Forest Island Crown Anchor Meadow Ridge Harbor Wing Trail".split()
THIRD = "Foods Textiles Robotics Bakery Logistics Motors Dental Press Tools Energy Software Pharma Mills Traders Builders Travels Ceramics Plastics Jewels Farms".split()
STREETS = "Main Oak Park Station Church Mill Lake Hill Market Garden".split()
KINDS = (("Street", "St", "Str."), ("Road", "Rd", "Rd."), ("Avenue", "Ave", "Av."), ("Lane", "Ln", "Lane"))
CITIES = {"us": ("Springfield", "Dayton", "Salem", "Austin"), "in": ("Bangalore", "Mumbai", "Delhi", "Chennai")}
ENDS = {"us": ("Inc", "LLC", "Corporation", "Company"), "in": ("Private Limited", "Pvt Ltd", "Limited", "LLP")}


def write(folder: str, split: str, entities: int, seed: int) -> None:
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    rows, truth = {1: [], 2: [], 3: []}, []

    def noisy(name: str) -> str:
        words = name.split()
        kind = r.random()
        if kind < 0.15:
            i = int(r.integers(len(words)))
            w = words[i]
            j = int(r.integers(1, len(w)))
            words[i] = w[: j - 1] + w[j] + w[j - 1] + w[j + 1 :]
        elif kind < 0.25:
            words = words[:2]
        elif kind < 0.35:
            words = [*words, pick(("Group", "Services", "Center"))]
        return " ".join(words).upper() if r.random() < 0.2 else " ".join(words)

    for i in range(entities):
        country = pick(("us", "in"))
        name, number, street, kind, city = f"{pick(FIRST)} {pick(SECOND)} {pick(THIRD)}", int(r.integers(1, 400)), pick(STREETS), pick(KINDS), pick(CITIES[country])
        postal = int(r.integers(10000, 10400) if country == "us" else r.integers(560000, 560300))
        place = lambda n, form: f"{n} {street} {kind[form]}, {city} {postal}"  # noqa: E731, B023
        rows[1].append((f"S1-{i}", f"{name} {pick(ENDS[country])}", place(number, 0), country))
        found = []
        for src in (2, 3):
            for _ in range(int(r.choice(3, p=(0.35, 0.5, 0.15)))):
                ident = f"S{src}-{len(rows[src])}"
                where = place(number, int(r.integers(3))) if r.random() < 0.9 else f"{street} {kind[1]}, {city}"
                rows[src].append((ident, f"{noisy(name)} {pick(ENDS[country])}".strip(), where, country if r.random() < 0.97 else ""))
                found.append(ident)
            if r.random() < 0.4:  # a look-alike nearby
                rows[src].append((f"S{src}-{len(rows[src])}", f"{name if r.random() < 0.5 else name.rsplit(' ', 1)[0] + ' ' + pick(THIRD)} {pick(ENDS[country])}", place(number + int(r.integers(1, 40)), 1), country))
        truth.append((f"S1-{i}", ",".join(found)))
    os.makedirs(f"{folder}/{split}", exist_ok=True)
    tables = {f"source{k}": [("entity_id", "business_name", "business_address", "country"), *part] for k, part in rows.items()} | {"ground_truth": [("source1_entity_id", "matched_entity_ids"), *truth]}
    for name, table in tables.items():
        with open(f"{folder}/{split}/{split}_{name}.tsv", "w") as f:
            f.write("\n".join("\t".join(x) for x in table) + "\n")


if __name__ == "__main__":
    size = int(sys.argv[2]) if len(sys.argv) > 2 else 4000
    write(sys.argv[1], "train", size, 1)
    write(sys.argv[1], "test", size // 4, 2)
