"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import ann, chat, decontam, graph, jaccard, langid, license, lines, mixing, quality, shingles, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, "one two three four five six seven", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "one two three four five six seven", "en", "a", 1),
    (4, "one two three four five six seven", "en", "a", 1),
    (None, "one two three four five six eight", "de", None, 2),
    (5, "word " * 5000, "en", "b", 25000),
    (6, "\n\n \n!!!\n", "fr", "b", 3),
]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def text_of(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# --- chat -------------------------------------------------------------------------------------------------------------


def test_escape_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s>", "<<SYS>><</SYS>>", "plain [x] <y>", "[INST", "<<s>", "a\\", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert back == t
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", e)


def test_role_escape(spark):
    roles = ["user", "a\nb", "a\\nb", "\\\\", "[INST]"]
    df = spark.createDataFrame([(r,) for r in roles], "r string").select("r", chat.unescape_role(chat.escape_role(F.col("r"))).alias("b"))
    assert all(r == b for r, b in df.collect())


def test_tree_branches(spark):
    # 1 - 2 - 3 (score 1), 1 - 4 - 5 - 6 (score 3), 1 - 7 (score 2)
    rows = [(1, None, "user", "q", 0.0), (2, 1, "assistant", "a", 1.0), (3, 2, "user", "b", 1.0), (4, 1, "assistant", "c", 3.0), (5, 4, "user", "d", 3.0), (6, 5, "assistant", "e", 3.0), (7, 1, "assistant", "f", 2.0)]
    messages = spark.createDataFrame(rows, "id long, parent long, role string, text string, score double")
    best = chat.format_conversations(messages).collect()
    assert [r["path"] for r in best] == [6]
    assert best[0]["formatted"] == "<s>[INST]user\nq[/INST]c</s>[INST]user\nd[/INST]e</s>"
    spans = [best[0]["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in best[0]["spans"]]
    assert spans == ["c", "e"]
    paths = defaultdict(list)
    for r in chat.ranked_paths(messages.select("id", "parent", "score"), 3).orderBy("path", "place").collect():
        paths[r["path"]].append(r["id"])
    assert paths == {6: [1, 4, 5, 6], 7: [1, 7], 3: [1, 2, 3]}


def test_long_chain_and_edges(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)] + [(2, 0, None, None), (None, 0, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    out = {r["conv_id"]: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))).collect()}
    assert set(out) == {1, 2, 3, None, -1}
    assert out[1]["n_turns"] == 300 and out[3]["n_turns"] == 2
    want = "".join(f"{'user' if i % 2 else 'assistant'}\nt{i}\n" for i in range(300))
    assert out[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert out[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()


# --- nearest neighbours -----------------------------------------------------------------------------------------------


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 50:
            continue
        best = {}
        for i, w in good:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -2), float(ann.cosine(v[None], w[None])[0]))
        out[q] = [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def test_ann_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(400)]  # many equal vectors
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [float("nan")] + [1.0] * 7), (2200, [1.0, 2.0]), (2250, [2.0, 4.0]), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    for block in (4096, 7):
        got = defaultdict(list)
        for r in ann.nearest(df, df.where("vec_id % 50 = 0"), query_block=block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        assert dict(got) == {k: v for k, v in brute(rows, 5).items() if v}


def test_ann_relaxed_and_empty(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {(r["query_id"], r["vec_id"]) for r in ann.every_fiftieth(df).collect()}
    loose = {(r["query_id"], r["vec_id"]) for r in ann.every_fiftieth(df, relax=0.7).collect()}
    assert len(exact & loose) >= 0.9 * len(exact)
    assert ann.every_fiftieth(df.where("false")).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def test_decontam_substitutions(spark):
    rng = random.Random(3)
    item = [f"b{i}" for i in range(30)]
    noise = lambda n: [f"n{rng.randrange(500)}" for _ in range(n)]
    changed = list(item)
    for i in range(4, 30, 7):
        changed[i] = "zz"
    half = item[:18]
    docs = [(1, " ".join(noise(50) + item + noise(50))), (2, " ".join(noise(20) + changed + noise(3))), (3, " ".join(half + noise(60))), (4, " ".join(noise(300))), (5, None), (6, ""), (7, " ".join(item[:5] + noise(30)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    b = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None)], "item_id long, text string")
    for limit in (decontam.BROADCAST_SEEDS, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(d, b, limit).collect()}
        assert got == {(1, 10), (2, 10), (3, 10)}
    assert {r["doc_id"] for r in decontam.decontaminated(d, b).collect()} == {4, 5, 6, 7}
    assert decontam.overlaps(d.where("false"), b).count() == 0 and decontam.overlaps(d, b.where("false")).count() == 0


@pytest.mark.parametrize("changed, seeded", [(3, 554), (4, 1672)])
def test_decontam_every_window(spark, changed, seeded):
    item = [f"b{i}" for i in range(40)]
    docs, want = [], set()
    for n, gone in enumerate(itertools.combinations(range(16), changed)):
        docs.append((n, " ".join(["x"] * 20 + [f"s{i}" if i in gone else item[12 + i] for i in range(16)] + ["y"] * 20)))
        if any(all(c == "0" or at + k not in gone for k, c in enumerate(m)) for m in decontam.MASKS for at in range(17 - len(m))):
            want.add(n)
    assert len(want) == seeded
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for limit in (decontam.BROADCAST_SEEDS, 0):
        got = decontam.overlaps(d, b, limit).collect()
        assert {r["doc_id"] for r in got} == want and {(r["matched"], r["width"]) for r in got} == {(16 - changed, 16)}


# --- lines ------------------------------------------------------------------------------------------------------------


def lines_brute(docs):
    def one_edit(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    every = []
    for d, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            w = [x for x in re.split(r"[ \t\r\f\x0b]+", line) if x]
            if w:
                every.append(((-(2**63) if d is None else d), k, w))
    gone = defaultdict(set)
    for d, k, w in every:
        if any((e, j) < (d, k) and (v == w or (min(len(v), len(w)) >= lines.MIN_NEAR and one_edit(v, w))) for e, j, v in every):
            gone[d].add(k)
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[-(2**63) if d is None else d]) for d, t in docs}


def test_lines_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 12))] for _ in range(25)]
    docs = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(1, 7)):
            w = list(rng.choice(base))
            edit = rng.randrange(4)
            at = rng.randrange(len(w))
            w = w if edit == 0 else w[:at] + ["new"] + w[at:] if edit == 1 else w[:at] + w[at + 1 :] if edit == 2 else w[:at] + ["sub"] + w[at + 1 :]
            own.append((" " if rng.random() < 0.8 else "\t ").join(w))
        docs.append((d * 3, "\n".join(own)))
    docs += [(1000, None), (1001, ""), (1002, "\n \n"), (None, " ".join(base[0]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line_no", F.lit(7)).withColumn("n_near", F.lit("x"))
    want = lines_brute(docs)
    for limit in (lines.FILTER_KEYS, 0):
        got = {r["doc_id"]: r["text"] for r in lines.with_counts(df, limit).collect()}
        assert got == want


def test_lines_edges(spark, edge, empty):
    assert lines.with_counts(empty).count() == 0
    out = lines.with_counts(edge)
    assert out.count() == len(EDGE)
    kept = lines.deduplicated(edge)
    assert kept.columns == edge.columns
    long_line = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(20000))), (2, " ".join(f"x{i}" for i in range(20000) if i != 777))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_near"] for r in lines.with_counts(long_line).collect()} == {1: 0, 2: 1}


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mixing(spark, edge, empty):
    rows = [(i, "x" * 10, "en", "big" if i % 10 else "small", 10) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs, weights={"big": 0.5, "small": 0.5})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 1500) < 200 and abs(n["small"] - 1500) < 200
    assert out.count() == mixing.mix(docs.repartition(7), weights={"big": 0.5, "small": 0.5}).count()
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(edge.withColumn("copy_no", F.lit(9))).columns.count("copy_no") == 1
    one = spark.createDataFrame([(i, "y" * 5, "en", "s" if i == 0 else "t", 5) for i in range(200)], DOCS)
    large = mixing.mix(one, weights={"s": 1.0, "t": 0.0}).groupBy("source").count().collect()
    assert [r["source"] for r in large] == ["s"] and abs(large[0]["count"] - 200) < 80


# --- language ---------------------------------------------------------------------------------------------------------


def test_langid(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.where("lang = lang_pred").count(), out.count()
    assert n > 30 and right >= 0.95 * n
    got = {r["doc_id"]: r for r in langid.predictions(edge.withColumn("score", F.lit(1))).collect()}
    assert got[2]["lang_pred"] == "und" and got[3]["lang_pred"] == "und" and got[6]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predictions(empty).count() == 0
    assert {r["lang_pred"] for r in langid.predictions(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- licences ---------------------------------------------------------------------------------------------------------


def test_license(spark, edge, empty):
    texts = [
        (1, "Released under the MIT-License. x\nunder the mit license"),
        (2, "APACHE license, version 2.0 and cc by nc"),
        (3, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        (4, "license license mit under the"),
        (5, None),
        (6, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (10, 2, 1, 6, "mit")
    assert got[2]["base_labels"] == "apache-2,cc-by-nc" and got[2]["n_base"] == 2
    assert got[3]["labels"] == "bsd" and got[3]["base_labels"] == ""
    assert (got[4]["labels"], got[4]["score"], got[4]["first_word"]) == ("", 0.0, None)
    assert (got[5]["n_words"], got[5]["labels"]) == (0, "")
    assert got[6]["labels"] == "gpl-3"
    assert license.scan(empty).count() == 0 and license.scan(edge).count() == len(EDGE)


def test_license_several_texts(spark):
    texts = [". ".join(t for _, t, _ in license.TEMPLATES), ". ".join(t for label, t, _ in license.TEMPLATES if label in ("mit", "bsd"))]
    texts += [f"{' '.join(license.VOCABULARY)}. {t}. {' '.join(reversed(license.VOCABULARY))}" for _, t, _ in license.TEMPLATES]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["labels"] == ",".join(sorted({label for label, _, _ in license.TEMPLATES}))
    assert got[1]["labels"] == "bsd,mit"
    for i, (label, _, _) in enumerate(license.TEMPLATES, 2):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0


# --- WARC -------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", "small"), (4, "u4", "small"), (5, None, None), (6, "u\r\nX: y", "a\r\n\r\nb"), (None, "u", big), (7, "u", big), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = [tuple(r) for r in warc.warc_round_trip(pages).collect()]
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if h == big and i != 7 else "response", 7 if h == big and i != 7 else None) for i, _, h in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.warc_round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader(zip64):
    p = warc.Package()
    for i in range(50):
        p.add(i, "response", warc.record(i, "u", f"payload {i}".encode(), None, False))
    content = p.packed(zip64)
    reads = []

    def read(at, n):
        reads.append(n)
        return content[at : at + n]

    r = warc.ZipReader(read, len(content))
    assert set(r.members) == {warc.DATA, warc.INDEX}
    assert [warc.described(*x)["page_id"] for x in warc.read_records(r)] == list(range(50))
    with pytest.raises(ValueError):
        r.range(warc.DATA, 0, 10**9)
    with pytest.raises(ValueError):
        warc.ZipReader(lambda at, n: b"nothing"[at : at + n], 7)


# --- Jaccard ----------------------------------------------------------------------------------------------------------


def jaccard_brute(docs):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = {i: grams(t) for i, t in docs}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for i in ids:
        for j in ids:
            if i < j and s[i] and s[j]:
                both = len(s[i] & s[j])
                if 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in ids}


def test_jaccard_brute_force(spark):
    rng = random.Random(5)
    docs = []
    passage = text_of(rng, 40, 1000).split()
    for g in range(25):
        base = text_of(rng, rng.randrange(3, 200), 5000).split()
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w += passage
            docs.append((len(docs) * 7 % 1009, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  B"), (2005, "a b c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit(1)).withColumn("n", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(df).collect()}
    assert got == jaccard_brute(docs)


def test_jaccard_edges(spark, edge, empty):
    assert jaccard.linked(empty).count() == 0
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.linked(edge).collect()]
    assert len(got) == len(EDGE)
    assert {(d, c) for d, _, c in got} == {(1, 1), (2, 2), (3, 3), (4, 1), (None, None), (5, 5), (6, 6)}


def test_bucket_pairs_long_lists():
    rng = np.random.default_rng(6)
    n = 1500
    tok, gid = np.zeros(n, np.uint32), np.arange(n, dtype=np.int64)
    low = rng.integers(50, 400, n).astype(np.int32)
    at = (rng.random(n) * low / 4).astype(np.int32)
    got = set()
    for a, b, c, need in jaccard._bucket_pairs(tok, gid, low, low, at, at):
        assert (c == 1).all()
        got |= set(zip(a.tolist(), b.tolist(), strict=True))
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            x, y = int(low[i]), int(low[j])
            least = -(-3 * (x + y) // 7)
            k = 1 + least // jaccard.EARLY
            if 4 * x >= 3 * y and 4 * y >= 3 * x and min(at[i], at[j]) + 1 + min(x - 1 - at[i], y - 1 - at[j]) >= least and at[i] < x - least + k and at[j] < y - least + k:
                want.add((i, j))
    assert got == want


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in links for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_shingle_sets_match_words():
    a, b, c = shingles.sets(["One two  three four five six", "one TWO three\nfour five six", "one two three four five seven"])
    assert np.array_equal(a, b) and len(a) == 2 and shingles.common(a, c) == 1
    joined = shingles.sets(["ab cd", "abcd"])
    assert not np.array_equal(*joined)


# --- quality ----------------------------------------------------------------------------------------------------------


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by its definition, with dictionaries."""
    full = defaultdict(int)
    for t in texts:
        c = [quality.START] * (quality.ORDER - 1) + quality.codes(t).tolist()
        for i in range(len(c) - quality.ORDER + 1):
            full[tuple(c[i : i + quality.ORDER])] += 1
    counts = {quality.ORDER: full}
    for o in range(quality.ORDER - 1, 0, -1):
        counts[o] = defaultdict(int)
        for g in counts[o + 1]:
            counts[o][g[1:]] += 1
    cuts = {}
    for o, c in counts.items():
        t = [sum(v == k for v in c.values()) for k in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0
        cuts[o] = [0.0] + [max(min(k - (k + 1) * y * t[k + 1] / t[k], k - 0.05), 0.05) if t[1] and t[2] and t[3] else 0.5 * k for k in (1, 2, 3)]

    def p(g):
        o = len(g)
        if not o:
            return 1 / 65536
        own = {k: v for k, v in counts[o].items() if k[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        cut = lambda v: cuts[o][min(v, 3)]
        back = sum(map(cut, own.values())) / total
        n = own.get(g, 0)
        return (max(n - cut(n), 0) / total if n else 0) + back * p(g[1:])

    return p


@pytest.mark.parametrize("shard_rows", [10**6, 40])
def test_quality_matches_definition(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(quality, "SHARD_ROWS", shard_rows)
    train = ["the cat sat on the mat", "a cat and a dog", "The dog sat\nthere", "mat and cat"]
    rows = spark.createDataFrame([("en", t) for t in train], "lang string, text string")
    p = kneser_ney(train)
    test = ["the cat", "zebra dog", "é"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(test)] + [(9, "xx", "q"), (10, "en", None)], "doc_id long, lang string, text string")
    learned = quality.stored(quality.model(rows), "test-model")
    got = {r["doc_id"]: r for r in quality.scored(docs, learned).collect()}
    for i, t in enumerate(test):
        c = [quality.START] * (quality.ORDER - 1) + quality.codes(t).tolist()
        want = -sum(np.log(p(tuple(c[k : k + quality.ORDER]))) for k in range(len(t)))
        assert got[i]["loss"] == pytest.approx(want, rel=1e-9)
    assert got[9]["loss"] is None and got[10]["n_chars"] == 0


def test_quality_edges(spark, sf, edge, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.classified(docs, labels).join(labels, "doc_id")
    kept = out.where("keep and quality = 1").count() / out.where("quality = 1").count()
    lost = out.where("not keep and quality = 0").count() / max(out.where("quality = 0").count(), 1)
    assert kept > 0.9 and lost > 0.6
    none = labels.where("false")
    assert quality.classified(empty, labels).count() == 0
    got = {r["doc_id"]: r for r in quality.classified(edge.withColumn("loss", F.lit(1)), none).collect()}
    assert got[1]["keep"] and not got[2]["keep"] and got[2]["perplexity"] is None and not got[3]["keep"]


# --- bounds, repeats and hot groups -----------------------------------------------------------------------------------


def test_jaccard_long_lists_and_small_blocks(spark, monkeypatch):
    """Lists that are cut up over tasks, and groups compared in several blocks, give the same components."""
    monkeypatch.setattr(jaccard, "LONG", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "DIFFERENCE_SETS", 3)
    rng = random.Random(11)
    base = text_of(rng, 60, 5000).split()
    docs = []
    for i in range(140):  # one large group around a text, some of it too far from its leader to link
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(df).collect()}
    assert got == jaccard_brute(docs)


def test_jaccard_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    near = a.replace("a20", "x")
    rows = [(5, a), (5, b), (5, b), (7, near), (3, b + " more"), (9, "other words stand here alone"), (None, a), (None, a)]
    rows += [(20, a)] * 300 + [(21, near)] * 300
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 36, 3): 3, (7, 36, 3): 1, (3, 37, 3): 1, (9, 1, 9): 1, (None, 36, None): 2, (20, 36, 3): 300, (21, 36, 3): 300})


def test_shingles_of_long_text():
    words = [f"w{i % 977}x{i % 31}" for i in range(200_000)]
    (got,) = shingles.sets([" ".join(words)])
    assert len(got) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert len(shingles.sets(["", None, "a b", "x " * 400_000, "q"])[3]) == 1


def test_short_masks_cover_two_substitutions():
    every = [*decontam.MASKS, *decontam.SHORT_MASKS]
    for n in range(decontam.FEW, decontam.MIN_MASKED):
        for gone in itertools.combinations(range(n), 2):
            assert any(all(c == "0" or at + k not in gone for k, c in enumerate(m)) for m in every for at in range(n - len(m) + 1))


def test_decontam_short_items(spark):
    items = [(1, "a b c"), (2, "w0 w1 w2 w3 w4 w5 w6 w7"), (3, ""), (None, "only"), (5, " ".join(f"v{i}" for i in range(10)))]
    docs = [
        (1, "x a B, c y"),
        (2, "a b x c"),
        (3, "q w0 w1 s w3 w4 s w6 w7"),
        (4, "w0 s w2 s w4 s w6 w7"),
        (None, "the only one"),
        (6, " ".join(f"v{i}" if i not in (0, 5) else "s" for i in range(10))),
        (6, None),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    for limit in (decontam.BROADCAST_SEEDS, 0):
        got = {(r["doc_id"], r["item_id"]): (r["matched"], r["width"]) for r in decontam.overlaps(d, b, limit).collect()}
        assert got == {(1, 1): (3, 3), (3, 2): (6, 8), (None, None): (1, 1), (6, 5): (8, 10)}
        assert sorted(r["doc_id"] for r in decontam.decontaminated(d, b).collect()) == [2, 4]


def test_langid_matches_dense_kernel(spark, sf):
    """Predictions against the kernel ridge regression written out in dense matrices over the same sample."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    rows = sorted((r["lang"], str(r["doc_id"]), r["text"]) for r in langid.sample(docs).collect())
    every = [r for r in docs.select("doc_id", "text").collect() if r["text"]]

    def spectrum(text):
        held = langid.presence([text])[0].astype(np.float64)
        return held / np.sqrt(held.sum())

    x = np.array([spectrum(t) for _, _, t in rows])
    names = sorted({lang for lang, _, _ in rows})
    which = np.array([names.index(lang) for lang, _, _ in rows])
    turn = [np.sum(which[:i] == c) for i, c in enumerate(which)]
    marks = x[sorted(range(len(rows)), key=lambda i: (turn[i], which[i]))[: max(langid.LANDMARKS, len(names))]]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    f = x @ marks.T @ root
    weight = len(rows) / (len(names) * np.bincount(which)[which])
    y = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = np.linalg.solve((f * weight[:, None]).T @ f + langid.RIDGE * len(rows) / 100 * np.eye(f.shape[1]), (f * weight[:, None]).T @ y)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predictions(docs).collect()}
    for r in every:
        if len(r["text"]) <= langid.PIECE:
            scores = spectrum(r["text"]) @ marks.T @ root @ w
            best = np.sort(scores)[::-1]
            assert got[r["doc_id"]][0] == names[int(scores.argmax())]
            assert abs(got[r["doc_id"]][1] - min(max((best[0] - best[1]) / langid.CERTAIN, 0), 1)) < 1e-3


def test_langid_bounds(spark):
    assert langid.lettered("é") and not langid.lettered("½ ² 12 _") and not langid.lettered(None)
    long = "abc " * (3 * langid.PIECE // 4 + 100)
    assert "".join(langid.pieces(long)) == long and len(langid.pieces(long)) == 3 and langid.pieces("") == [""]
    rows = [(1, "one text", "aa")] * 500 + [(i, f"words of {i}", f"l{i}") for i in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    assert langid.sample(df).groupBy("lang").count().agg(F.max("count")).first()[0] <= langid.TRAIN_ALL // 300
    out = langid.predictions(spark.createDataFrame([(1, "½ ²", "aa"), (5, "aa bb", "aa")], "doc_id long, text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in out.collect()}[1] == "und"


def test_ann_blocks_of_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = ann.nearest(df, df.where("vec_id % 10 = 0"), 4).collect()
    parts = ann.nearest(df, df.where("vec_id % 10 = 0"), 4, query_block=7).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 160


def test_quality_threshold_and_keep(spark):
    rng = random.Random(9)
    logp = [(lang, rng.random() * 4) for lang in ("a", "b") for _ in range(137)] + [("c", 1.0)] * 5
    got = {r["lang"]: r["limit"] for r in quality.thresholds(spark.createDataFrame(logp, "lang string, logp double"), 0.9).collect()}
    for lang in "abc":
        own = sorted(math.ceil(p / quality.BIN) for x, p in logp if x == lang)
        assert abs(got[lang] - own[math.ceil(len(own) * 0.9) - 1] * quality.BIN) < 1e-9
