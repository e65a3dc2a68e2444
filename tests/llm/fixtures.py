"""Small tables with the hard cases: nulls, empty and long texts, copies, near copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size string, `node.x` string"
WORDS = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in ("", "n", "r", "sta")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(5)
    passage = prose(rng, 70)
    base = prose(rng, 120)
    near = base.split(" ")
    near[7] = near[60] = "changed"
    rows = [
        prose(rng, 40), None, "", " \t\n", "!!! 123 ...", base, base, " ".join(near), base.upper(), prose(rng, 30) + " " + passage + " " + prose(rng, 25), passage + "\n" + prose(rng, 60),
        prose(rng, 20) + " " + passage, "a" * 450, "ab" * 300, "été " * 90 + prose(rng, 9), "éà" * 160, prose(rng, 4), prose(rng, 3), "one two three four", "one two three four five", "one two three four five",
        "Released under the MIT License. Licensed under CC BY-NC 4.0. Under the mit license", "cc by", "Licensed under the Apache License, Version 2.0.", prose(rng, 9000), "x" + "́ y z <|endoftext|> it's 12", "\x00nul\x00 byte",
    ]
    for k in range(14):
        more = base.split(" ")
        more[rng.randrange(len(more))] = f"v{k}"
        rows.append(" ".join(more))
    return rows


def documents(spark, empty=False):
    rows = []
    for k, t in enumerate(texts()):
        rows.append((k, t, (None, "en", "fr", "de", "es")[k % 5], (None, "s1", "s0", "S9")[k % 4] if k % 9 else "s0", None if t is None else len(t), "r", None, "3", "d"))
    rows += [rows[5], rows[5], (None, "null id " + (rows[0][1] or ""), "en", "s1", 1, None, None, None, None), (7, "another with id seven", None, None, None, "r", "k", "s", "n")]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def as_tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
