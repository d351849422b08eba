"""Small tables with every awkward row."""

import json
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use themselves
CLASHES = "th string, n int, copy string, grp string, prefix string, h string, row string, spans string, hash string, ids string, lines_removed string, quality_score string, severity string, item_id string, norm string, name string, best string, id string, own string, quality_label string, __key string, __th string"


def documents(spark, rows, extra=False):
    """Documents from (doc_id, text); ``extra`` adds columns with clashing names."""
    out = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if extra:
        for column in CLASHES.split(", "):
            out = out.selectExpr("*", f"'x' AS {column.split()[0]}")
    return out


def prose(seed, words=80, vocabulary=4000):
    """Invented words: enough of them that texts are unlike each other."""
    pick = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = ["".join(random.Random(k).choices(letters, k=3 + k % 6)) for k in range(vocabulary)]
    out = []
    for k in range(words):
        out.append(pick.choice(lexicon))
        if k % 9 == 8:
            out[-1] += "." if k % 18 else ".\n"
    return " ".join(out).replace("\n ", "\n")


def awkward():
    """(doc_id, text): nulls, empty and odd texts, a very long text, copies, repeated rows."""
    base = prose(1, 120)
    return [
        (None, None),
        (None, "no id " + prose(2)),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "two words"),
        (6, base),
        (7, base),
        (7, base),
        (8, prose(3, 6000)),
        (9, "Ünï çödé 中文字 😀 \x00 \x1c <|endoftext|> </w> don't I'VE Σσς " + prose(4, 30)),
        (-5, base.upper()),
        (10, prose(5)),
        (10, prose(6)),
    ]


def found(df, key="doc_id"):
    """key -> sorted rows as dictionaries."""
    out = {}
    for row in df.collect():
        out.setdefault(row[key], []).append(row.asDict(recursive=True))
    return {k: sorted(v, key=lambda r: json.dumps(r, default=str, sort_keys=True)) for k, v in out.items()}
