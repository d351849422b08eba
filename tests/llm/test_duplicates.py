"""Line dedup, Jaccard join, embedding near-dedup and decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from serieslake.llm import decontaminate, embedding_dedup, line_dedup, ngram_join, queries
from serieslake.llm.common import components
from tables import awkward, documents, found, prose


def least_reachable(nodes, edges):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components_of_chains_stars_and_loops(spark):
    pick = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(200, 230)] + [(7, 7), (None, 3)]
    edges += [(pick.randrange(600, 700), pick.randrange(600, 700)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == least_reachable({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- line dedup


def test_repeated_passages_go_and_first_ones_stay(spark):
    lines = [f"{prose(k, 14).replace(chr(10), ' ')}" for k in range(40)]
    passage = lines[:6]
    long = prose(99, 60).replace("\n", " ")
    rows = [
        (1, "\n".join([*lines[10:14], *passage, *lines[14:16]])),
        (2, "\n".join([*lines[20:22], *passage, *lines[22:26]])),
        (3, "\n".join([*lines[26:30], long])),
        (4, "\n".join([long, *lines[30:34]])),
        (5, "\n".join(lines[34:40])),
    ]
    got = {k: v[0] for k, v in found(line_dedup.dedup_lines(documents(spark, rows, extra=True))).items()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1] and got[5]["text"] == rows[4][1]
    assert got[2]["text"] == "\n".join([*lines[20:22], *lines[22:26]]) and got[2]["lines_removed"] == 6
    assert got[4]["text"] == "\n".join(lines[30:34])
    assert got[4]["n_chars"] == len(got[4]["text"]) and got[4]["th"] == "x"


def test_nothing_is_lost_and_nothing_unique_goes(spark):
    pick = random.Random(5)
    pool = [prose(k, pick.randrange(1, 40)).replace("\n", " ") for k in range(60)]
    rows = [(i, "\n".join(pick.choices(pool, k=pick.randrange(1, 12)) + [f"only {i}"])) for i in range(80)]
    got = {k: v[0] for k, v in found(line_dedup.dedup_lines(documents(spark, rows))).items()}
    kept = [line for r in got.values() for line in r["text"].split("\n")]
    assert {line for _, t in rows for line in t.split("\n")} == set(kept)
    for i, text in rows:
        assert got[i]["lines_removed"] == len(text.split("\n")) - len(got[i]["text"].split("\n"))
        assert f"only {i}" in got[i]["text"]
    assert sum(r["lines_removed"] for r in got.values()) > 50


def test_repeated_passages_of_short_lines_always_go(spark):
    rows, passages = [], {}
    for n in range(1, 10):
        for trial in range(4):
            words = prose(5000 + 10 * n + trial, 52).split()
            passage = "\n".join(" ".join(words[k : k + n]) for k in range(0, 52, n))
            for copy in range(2):
                around = prose(7000 + len(rows), 60).split()
                before, after = ["\n".join(" ".join(half[k : k + n]) for k in range(0, 30, n)) for half in (around[:30], around[30:])]
                rows.append((len(rows), f"{before}\n{passage}\n{after}"))
                passages[len(rows) - 1] = (copy, passage, f"{before}\n{after}")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    for i, text in rows:
        copy, _, rest = passages[i]
        assert got[i] == (rest if copy else text)


def test_repeats_without_spaces_and_of_blank_lines_go(spark):
    chinese = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(60))
    tabs, hard = prose(8001, 30).split(), prose(8002, 30).split()
    lines = [chinese, "\t".join(tabs), "\u00a0".join(hard), "\n".join([chinese[::-1][:12], *[""] * 30, chinese[::-1][12:20], "end"])]
    rows = [(k, f"{k} only\n{lines[k % 4]}\n{k} too") for k in range(8)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {k: t if k < 4 else f"{k} only\n{k} too" for k, t in rows}


def test_a_chunk_that_overlaps_its_first_occurrence_stays(spark):
    rows = [(1, "\n".join(["la"] * 15)), (2, "\n".join(["du"] * 25))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\n".join(["du"] * 10)}


def test_boundaries_resist_shifts():
    text = prose(8, 900)
    whole = line_dedup._layout(text)
    shifted = line_dedup._layout("new first line\n" + text)
    cuts = {end for _, end in whole[2]}
    moved = {end - 1 for _, end in shifted[2]}
    assert len(cuts - moved) <= 1


def test_boundaries_of_short_lines_resist_shifts():
    """Far from an edit the same lines begin chunks, not all of them do, and lines of five words always do."""
    pick = random.Random(11)
    words = prose(9000, 2400).split()
    lines = [" ".join(words[6 * k : 6 * k + pick.randrange(1, 7)]) for k in range(400)]
    for cut in (1, 7, 50):
        whole = {a for a, _ in line_dedup._layout("\n".join(lines))[2]}
        moved = {a + cut for a, _ in line_dedup._layout("\n".join(lines[cut:]))[2]}
        assert {a for a in whole if a >= cut + 6} == {a for a in moved if a >= cut + 6}
    assert all(k in whole for k in range(380) if len(lines[k].split()) >= 5) and len(whole) < 350
    rolled = line_dedup._rolling(lines)
    assert rolled[40:] == line_dedup._rolling(lines[40:]) and rolled[7] == line_dedup._rolling(lines[7:9])[0]


def plain_chunks(lines):
    """(first, end) of the chunks by the rules of the module text, tried window by window."""
    size = [len(line.split()) for line in lines]
    out, run = [(i, i + 1) for i, n in enumerate(size) if n >= 10], []
    for i, n in enumerate([*size, 10]):
        if n >= 10:
            rolled = line_dedup._rolling([lines[k] for k in run])
            starts = {0}
            for a in range(len(run)):
                for b in range(a + 1, len(run) + 1):
                    if sum(size[k] for k in run[a:b]) >= 5:
                        starts |= {k for k in range(a, b) if rolled[k] == min(rolled[a:b])}
                        break
            for a in starts:
                ends = [b for b in range(a + 1, len(run) + 1) if sum(size[k] for k in run[a:b]) >= 10]
                out += [(run[a], run[ends[0] - 1] + 1)] if ends else []
            run = []
        elif n:
            run.append(i)
    return out


def plain_line_dedup(rows):
    texts = {i: t.split("\n") for i, t in rows}
    places = {}
    for i, lines in texts.items():
        for a, b in plain_chunks(lines):
            places.setdefault("\n".join(lines[a:b]), []).append((i, a, b))

    def near(lines, order):
        out, held = [], 0
        for k in order:
            held += len(lines[k].split())
            if held >= line_dedup.REACH or len(lines[k].split()) >= 10:
                break
            out.append(lines[k])
        return out

    def same(one, other):
        return next((k for k, (x, y) in enumerate(zip(one, other)) if x != y), min(len(one), len(other)))

    gone = {i: set() for i in texts}
    for found in places.values():
        (i, a, b), *later = sorted(found)
        for j, c, d in later:
            if j == i and c < b:
                continue
            first = c - same(near(texts[i], range(a - 1, -1, -1)), near(texts[j], range(c - 1, -1, -1)))
            end = d + same(near(texts[i], range(b, len(texts[i]))), near(texts[j], range(d, len(texts[j]))))
            gone[j] |= set(range(max(first, b) if i == j else first, end))
    return {i: "\n".join(line for k, line in enumerate(lines) if k not in gone[i]) for i, lines in texts.items()}


def test_line_dedup_equals_plain_python(spark):
    pick = random.Random(21)
    words = prose(9500, 3000).split()
    pool = [" ".join(words[25 * k : 25 * k + pick.choice((1, 2, 3, 4, 6, 9, 10, 25))]) for k in range(120)] + ["", "la", "la la"]
    passages = [pick.choices(pool, k=pick.randrange(3, 25)) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(pick.randrange(0, 5)):
            lines += pick.choice(passages) if pick.random() < 0.5 else pick.choices(pool, k=pick.randrange(1, 15))
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    wanted = plain_line_dedup(rows)
    assert got == wanted and sum(wanted[i] != t for i, t in rows) > 60


def test_line_dedup_of_one_very_long_text(spark):
    """A text of some megabytes, a copy of its middle, and a text of one line."""
    pick = random.Random(31)
    words = ["".join(pick.choices("abcdefghij", k=6)) for _ in range(20000)]
    lines = [" ".join(pick.choices(words, k=pick.randrange(1, 9))) for _ in range(120000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own start here", *lines[50000:60000], "own end there"])), (3, "x" * 2_000_000)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert len(rows[0][1]) > 3_000_000 and got == {1: rows[0][1], 2: "own start here\nown end there", 3: rows[2][1]}


def test_line_dedup_of_awkward_rows(spark):
    rows = awkward()
    got = found(line_dedup.dedup_lines(documents(spark, rows, extra=True)))
    assert sum(map(len, got.values())) == len(rows)
    assert got[6][0]["lines_removed"] == 0 and [r["text"] for r in got[7]] == ["", ""]
    assert got[1][0]["text"] == "" and got[2][0]["text"] == "" and got[4][0]["text"] == "one"
    assert sorted(r["text"] for r in got[10]) == sorted(t for i, t in rows if i == 10)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# --- n-gram Jaccard join


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(words) >= 4:
        return {tuple(words[k : k + 4]) for k in range(len(words) - 3)}
    return {tuple(words)} if words else set()


def linked(rows):
    """Component of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    edges = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    root = least_reachable(range(len(rows)), edges)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in root if root[m] == root[k] and rows[m][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(out, key=repr)


def check_join(spark, rows):
    got = ngram_join.similar(documents(spark, rows, extra=True)).drop("th", "root").collect()
    assert sorted(map(tuple, got), key=repr) == linked(rows)


def edited(text, pick, times):
    words = text.split(" ")
    for _ in range(times):
        words[pick.randrange(len(words))] = f"w{pick.randrange(10 ** 6)}"
    return " ".join(words)


def test_join_of_awkward_rows(spark):
    check_join(spark, awkward())
    assert ngram_join.similar(documents(spark, [])).count() == 0
    check_join(spark, [(1, None), (2, "")])


@pytest.mark.parametrize("seed", [1])
def test_join_of_near_copies_and_shared_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 4)  # so that this small table has frequent shingles
    pick = random.Random(seed)
    rows, k = [], 0
    shared = prose(1000 + seed, 25)
    for base in range(25):
        text = prose(base + 100 * seed, pick.randrange(4, 150))
        if base % 3 == 0:
            text = shared + " " + text
        for _ in range(pick.randrange(1, 8)):
            rows.append((pick.randrange(10**6), edited(text, pick, pick.randrange(0, 4))))
            k += 1
    rows += [(10**7 + n, edited(prose(77, 60), pick, n % 3)) for n in range(40)]  # one large group
    rows += [(10**8 + n, f"short text {n % 3}") for n in range(9)]
    check_join(spark, rows)


def test_join_at_another_threshold_and_shingle(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 4)
    pick = random.Random(12)
    rows = []
    for base in range(30):
        text = prose(3000 + base, pick.randrange(5, 160))
        for _ in range(4):
            copy = edited(text, pick, pick.randrange(0, 4)).split(" ")
            rows.append((pick.randrange(10**6), " ".join(copy[: round(len(copy) * pick.uniform(0.78, 1))])))
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    assert sum(0.8 <= j < 0.85 for j in alike.values()) > 10
    root = least_reachable(range(len(rows)), [p for p in pairs if 5 * len(sets[p[0]] & sets[p[1]]) >= 4 * len(sets[p[0]] | sets[p[1]])])
    want = []
    for k, (i, _) in enumerate(rows):
        want.append((i, len(sets[k]), min(rows[m][0] for m in root if root[m] == root[k]) if sets[k] else i))
    got = ngram_join.similar(documents(spark, rows), 5, 80).drop("th", "root").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_texts_that_share_shingles_by_chance_do_not_meet(spark, monkeypatch):
    pick = random.Random(5)
    texts = [" ".join(pick.choices("abcdefghi", k=120)) for _ in range(300)]  # 6561 shingles: each is in about 5 texts
    rows = list(enumerate([*texts, texts[0] + " z"]))
    met, settle = {}, ngram_join.settle

    def counted(df, name):
        out = settle(df, name)
        met[name] = max(met.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "settle", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar(documents(spark, rows)).collect()}
    assert got == {i: i % 300 for i in range(301)}
    assert 0 < met["shared-prefixes"] < 3000  # about 6,300 shingles lie in prefixes, nearly all of them in several


def test_one_of_each_keeps_all_columns_and_texts_without_words(spark):
    rows = awkward()
    kept = ngram_join.one_of_each(documents(spark, rows, extra=True))
    got = found(kept)
    assert kept.columns == documents(spark, [], extra=True).columns
    # -5, 6 and 7 are copies; both rows without words stay
    assert set(got) == {None, -5, 1, 2, 3, 4, 5, 8, 9, 10}
    assert len(got[10]) == 2 and len(got[None]) == 2


def test_join_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op7_ngram_jaccard_join(spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == linked(rows)


# --- embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, vec string")


def brute_links(rows):
    usable = {}
    for k, (_, v, *_rest) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[k] = np.array(v, np.float32).astype(float)
    edges = []
    for a in usable:
        for b in usable:
            if a < b and len(usable[a]) == len(usable[b]):
                cosine = usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b])
                if cosine >= 0.9:
                    edges.append((a, b))
    return edges


def test_embeddings_against_all_pairs(spark):
    pick = np.random.default_rng(1)
    base = pick.standard_normal((150, 16))
    rows = []
    for k in range(400):
        noise = pick.standard_normal(16) * pick.choice([0.05, 0.2, 0.4])
        rows.append((1000 - k, (base[k % 150] * pick.choice([1.0, 3.0]) + noise).tolist(), 0, "x", "x"))
    rows += [(2000 + k, base[0].tolist(), 0, "x", "x") for k in range(5)]  # copies
    rows += [(2000, base[0].tolist(), 0, "x", "x")]
    rows += [(3001, None, 0, "x", "x"), (3002, [], 0, "x", "x"), (3003, [0.0] * 16, 0, "x", "x")]
    rows += [(3004, [float("nan")] * 16, 0, "x", "x"), (3005, [float("inf")] + [1.0] * 15, 0, "x", "x"), (3006, [None] + [1.0] * 15, 0, "x", "x")]
    rows += [(3007, [1.0, 2.0], 0, "x", "x"), (None, base[1].tolist(), None, None, None)]
    got = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    edges = brute_links(rows)
    want = sum(r["n_links"] for r in got) / 2
    assert 0.95 * len(edges) <= want <= len(edges)
    degree, by_id = {}, {}
    for a, b in edges:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    for k, row in enumerate(rows):
        by_id.setdefault(row[0], []).append(degree.get(k, 0))
    for r in got:
        assert r["n_links"] <= max(by_id[r["vec_id"]])
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    exact = {r["vec_id"]: r for r in got}
    assert all(exact[i]["n_links"] == 0 and exact[i]["component_id"] == i for i in range(3001, 3008))
    assert len(got) == len(rows)


def test_vectors_of_every_length_are_compared(spark):
    pick = random.Random(12)
    rows = [(k, [2.0, 1.0]) for k in range(3)] + [(10 + k, [1.0, 2.0, 3.0]) for k in range(6)] + [(20, [3.0]), (21, [4.0]), (22, [-1.0])]
    for length in (5, 8):
        for k in range(40):
            base = [pick.gauss(0, 1) for _ in range(length)]
            rows += [(100 * length + 2 * k, base), (100 * length + 2 * k + 1, [x + pick.gauss(0, 0.01) for x in base])]
    rows += [(5000, [1.0] * 7)]  # the only one of its length
    table = vectors(spark, [(*row, 0, "x", "x") for row in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table).collect()}
    assert len(got) == len(rows) and got[5000] == (0, 5000)
    assert got[0] == (2, 0) and got[12] == (5, 10) and got[20] == (1, 20) and got[21] == (1, 20) and got[22] == (0, 22)
    for length in (5, 8):
        for k in range(40):
            one, two = got[100 * length + 2 * k], got[100 * length + 2 * k + 1]
            assert one[0] >= 1 and two[0] >= 1 and one[1] == two[1]


def test_few_and_no_vectors(spark):
    def run(rows):
        return sorted(map(tuple, embedding_dedup.near_duplicates(vectors(spark, rows)).collect()))

    assert run([]) == []
    assert run([(5, [1.0, 0.0], 0, "", "")]) == [(5, 0, 5, True)]
    assert run([(5, [1.0, 0.0], 0, "", ""), (2, [2.0, 0.1], 0, "", ""), (9, [0.0, 1.0], 0, "", "")]) == [(2, 1, 2, True), (5, 1, 2, False), (9, 0, 9, True)]


def test_embedding_recall_on_the_given_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = sum(int((v[k : k + 500] @ v.T >= 0.9).sum()) for k in range(0, len(v), 500)) - len(v)
    got = queries.op2_embedding_near_dedup(spark, folder).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * links <= got <= links


# --- decontamination


def test_replaced_words_are_tolerated_and_clean_texts_left(spark):
    item = prose(50, 40)
    words = item.replace("\n", " ").split()
    swapped = " ".join("zzz" if k % 6 == 5 else w for k, w in enumerate(words))
    shuffled = " ".join(random.Random(3).sample(words, len(words)))
    rows = [
        (1, prose(51, 50) + " " + item + " " + prose(52, 20)),
        (2, prose(53, 50) + "\n" + swapped.upper() + " " + prose(54, 20)),
        (3, shuffled),
        (4, prose(55, 400)),
        (5, " ".join(words[10:28])),
        (6, " ".join(words[:7])),
    ]
    bench = spark.createDataFrame([(1, item), (2, prose(60, 30)), (3, None), (4, ""), (5, "too short"), (None, prose(61, 20))], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, rows, extra=True), bench).collect())
    assert got == [(1, 1), (2, 1), (5, 1)]
    kept = decontaminate.without_leaks(documents(spark, rows + [(None, None), (None, prose(61, 20))]), bench)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 6}


def test_no_replaced_words_of_short_items_escape(spark):
    items, rows, want = [], [], set()
    for n in range(1, 13):
        words = [f"item{n}word{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        allowed = n - -(-8 * n // 10) if n > 5 else 0
        for count in range(allowed + 1):
            for gone in itertools.combinations(range(n), count):
                rows.append((len(rows), " ".join(["before it", *("zzz" if k in gone else w for k, w in enumerate(words)), "after"])))
                want.add((rows[-1][0], n))
        gone = random.Random(n).sample(range(n), allowed + 1)  # one too many
        rows.append((len(rows), " ".join("zzz" if k in gone else w for k, w in enumerate(words))))
        rows.append((len(rows), "none of it"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert got == want
    bench = bench.where("item_id > 1")  # without single words, pairs are looked up first
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert got == {(d, i) for d, i in want if i > 1}


def test_decontamination_of_awkward_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, prose(1, 120)), (1, prose(1, 120))], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = documents(spark, awkward(), extra=True)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(rows, bench).collect()) == [(-5, 1), (6, 1), (7, 1)]
    assert decontaminate.leaks(rows, none).count() == 0
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0


def test_leaks_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    tokens = lambda text: [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    items = {r["item_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    places = {}
    for i, words in items.items():
        for k in range(len(words)):
            places.setdefault(words[k], []).append((i, k))
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words, runs = tokens(r["text"]), {}
        for p, w in enumerate(words):
            for i, k in places.get(w, ()):
                runs.setdefault((i, p - k), []).append(k)
        for (i, _), ks in runs.items():
            length = min(13, len(items[i]))
            if any(sum(s <= k < s + length for k in ks) >= -(-8 * length // 10) for s in ks):
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_benchmark_leaks(spark, folder).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 10
