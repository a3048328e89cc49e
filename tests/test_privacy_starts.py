"""The start that is looked for before a pattern's edge changes no match."""

import random

from pyspark.sql import functions as F

from credsight.functions import privacy as PV


def test_pattern_starts_change_no_match(spark):
    rng = random.Random(5)
    bits = ["123-45-6789", "4111 1111 1111 1111", "GB82WEST12345698765432", "a.b+c@x-y.example.org", "1999-12-31", "31/12/2001", "12345678",
            "+1 (555) 123-4567", "555 123 4567", "é", "_", "x", "9", " ", "-", "@", ".", "AB1", "(", "+", "\n", "ß12", "00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _, p, tok in PV.PATTERNS:
        assert PV.edged(p).startswith("(?=")
        plain = p.replace(r"\b", PV.EDGE)
        found = df.select(F.regexp_replace("t", PV.edged(p), tok).eqNullSafe(F.regexp_replace("t", plain, tok)).alias("same"),
                          F.regexp_count("t", F.lit(PV.edged(p))).eqNullSafe(F.regexp_count("t", F.lit(plain))).alias("as_many"))
        assert found.where("NOT (same AND as_many)").count() == 0, p
