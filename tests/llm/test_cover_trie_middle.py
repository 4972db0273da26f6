"""The operators 11 to 13 against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from vesper.llm import cover, middle, queries, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
hex_of = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- difference-cover anchors


@pytest.mark.parametrize("period", cover.COVERS)
def test_covers_have_every_difference(period):
    members = cover.COVERS[period]
    assert all(any((i + k) % period in members and (j + k) % period in members for k in range(period)) for i in range(period) for j in range(period))


def plain_cover(docs, length):
    last = 1 << 63
    words = [WORD.findall(t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            least[key] = min(least.get(key, last), last if i is None else i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < (last if i is None else i):
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hex_of(kept), kept))
    return sorted(out, key=str)


def found_cover(spark, docs, length=13, **more):
    rows = cover.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), length=length, **more).collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] and hex_of(r["kept"]) == r["kept_sha256"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in rows), key=str)


@pytest.mark.parametrize(("length", "words"), [(13, 2), (13, 40), (4, 3), (1, 30), (50, 2), (30, 300)])
def test_cover_equals_plain(spark, length, words):
    rng = random.Random(length * words)
    passages = [[f"w{rng.randrange(words)}" for _ in range(rng.randrange(1, 4 * length))] for _ in range(12)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randrange(1, 3 * length)] + [f"w{rng.randrange(words)}" for _ in range(rng.randrange(3))]
        docs.append((i * 3 % 60, rng.choice([" ", "\n", " \t", "\x0b"]).join(parts)))
    assert found_cover(spark, docs, length) == plain_cover(docs, length)


def test_cover_edges(spark):
    a = " ".join(f"a{k}" for k in range(20))
    docs = [(None, a), (None, "x " + a), (7, a), (7, a), (3, "pre " + a + " post"), (9, None), (10, ""), (11, " \n\t "), (12, "é ü " * 12), (13, "é ü " * 13), (14, "é ü " * 40), (1 << 62, a), (-5, a[3:]), (8, a), (8, "other " + a)]
    assert found_cover(spark, docs) == plain_cover(docs, 13)
    assert found_cover(spark, []) == []
    clash = spark.createDataFrame([(1, "t", 5, "k")], "doc_id long, text string, id long, row string").withColumn("data", F.lit(1))
    assert cover.deduplicate(clash).columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"] and cover.deduplicate(clash).count() == 1


def test_cover_rows_of_one_id_and_equal_low_bits(spark):
    docs = [(1, " ".join(f"a{k}" for k in range(40)))] + [(None, " ".join([f"n{i}"] * (i % 30 + 1)) + " " + " ".join(f"a{k}" for k in range(i % 20, i % 20 + 15))) for i in range(1500)]
    low = spark.createDataFrame(docs, "doc_id long, text string").where("doc_id IS NULL").select(F.xxhash64("text").bitwiseAND(cover.SHORT).alias("x"))
    assert low.distinct().count() < 1500  # some meet in one group
    assert found_cover(spark, docs) == plain_cover(docs, 13)


def test_cover_shuffles_texts_once(spark, tmp_path):
    shared = " ".join(f"a{k}" for k in range(20))
    spark.createDataFrame([(i, f"{i} {shared if i % 2 else ''}") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.queries()["op11_substring_dedup"](spark, str(tmp_path))
        assert sum(r["n_removed"] for r in df.collect()) == 24 * 20
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


@pytest.mark.parametrize("ids", [[5], [7, 7 + (1 << 32) - 1], [7, 7 + (1 << 32)], [-(1 << 63), 0, (1 << 63) - 1], [-3, 4]])
def test_ids_of_postings(ids):
    base, data = cover._narrow(np.array(ids))
    assert cover._widened(base, data, len(ids)).tolist() == ids and len(data) == (4 if max(ids) - min(ids) < 1 << 32 else 8) * len(ids)


def test_cover_long_texts_and_pieces(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50)}" for _ in range(400_000)]
    long = " ".join(words)
    docs = [(1, long), (2, "y" * 3_000_000 + " " + " ".join(words[300_000:300_030]) + " z"), (3, " ".join(words[200_000:399_000])), (4, "q " * 1_200_000)]
    assert found_cover(spark, docs) == plain_cover(docs, 13)
    text = long.encode()
    seen = [w for before, part in cover.pieces(text, 12) for w in part[: len(part) - 12 if before + len(part) < len(words) else None]]
    assert seen == text.split() and len(list(cover.pieces(text, 12))) > 1


def test_cover_hot_passage_over_batches(spark):
    line = " ".join(f"l{k}" for k in range(15))
    docs = [(i, f"u{i} v{i} {line} e{i}" if i % 3 else line) for i in range(300)]
    found = found_cover(spark.newSession(), docs, bucket=100)
    assert found == plain_cover(docs, 13) and sum(r[2] for r in found) == 15 * 299


# --- prefix trie


def plain_trie(seqs):
    """seqs: conversation to list of (role, text)."""
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, cs in members.items():
        own = (len(cs) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += k not in kids
    return sorted((min(cs), len(k), min(members[k[:-1]]) if k else -1, len(cs), kids[k], leaves[k], saved[k], hex_of(",".join(str(c) for c in cs if len(seqs[c]) == len(k)))) for k, cs in members.items())


def found_trie(nodes):
    return sorted((r["conv"], r["depth"], -1 if r["parent"] is None else r["parent"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in nodes.collect())


def sequences(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", ""]), " ".join("w" for _ in range(rng.randrange(4)))) for _ in range(3)]
    trunk = [rng.choice(turns) for _ in range(8)]
    seqs = {}
    for c in range(-3, 60):
        s = trunk[: rng.randrange(9)] + [rng.choice(turns) for _ in range(rng.randrange(4))]
        seqs[c] = s if rng.random() < 0.8 else list(seqs.get(c - 1, []))
    return seqs


def rows_of(spark, seqs):
    data = [(c, k, r, t) for c, s in seqs.items() for k, (r, t) in enumerate(s)]
    rows = trie.numbered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    return rows, spark.createDataFrame([(c,) for c in seqs], "conv long")


@pytest.mark.parametrize(("seed", "local", "chunk"), [(1, 1 << 14, 64), (2, 1, 4), (4, 12, 1)])
def test_trie_equals_plain(spark, monkeypatch, seed, local, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    seqs = sequences(seed)
    nodes, turns = trie.trie(*rows_of(spark, seqs), local=local)
    assert found_trie(nodes) == plain_trie(seqs)
    assert nodes.where("depth > 0").join(turns, "turn_id").count() == nodes.where("depth > 0").count()


def test_trie_of_snapshots_and_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 8)
    turns = [("user", f"turn {k}") for k in range(12)]
    seqs = {c: turns[: c % 13] for c in range(26)} | {c: turns for c in range(100, 140)} | {200: [], 201: [("user", "other")]}
    assert found_trie(trie.trie(*rows_of(spark, seqs), local=20)[0]) == plain_trie(seqs)


def test_ids_are_digested_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "PART", 7)
    seqs = {c: [("user", "same")] if c % 3 else [] for c in range(200)}
    assert found_trie(trie.trie(*rows_of(spark, seqs))[0]) == plain_trie(seqs)


def test_trie_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows = trie.numbered(empty)
    assert trie.trie(rows, rows.select("conv"))[0].count() == 0
    data = [(1, None, "user", "first"), (1, 5, None, None), (1, 2, "user", "mid"), (None, 1, "user", "lost"), (2, 0, "b", "x"), (2, 0, "a", "y"), (2, 0, "a", "y"), (3, 1 << 40, "user", "w " * 50_000)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("p"), "conv": F.lit(0), "one": F.lit("1"), "_b": F.lit(2)})
    rows = trie.numbered(frame).collect()
    assert sorted((r["conv"], r["pos"], r["words"]) for r in rows) == [(1, 0, 1), (1, 1, 1), (1, 2, 0), (2, 0, 1), (2, 1, 1), (2, 2, 1), (3, 0, 50_000)]
    order = [r["digest"] for r in sorted((r for r in rows if r["conv"] == 2), key=lambda r: r["pos"])]
    assert order == sorted(order) and len(set(order)) == 2


def test_a_very_long_conversation(spark):
    seqs = {5: [("user", f"t{k % 7}") for k in range(400)], 6: [("user", f"t{k % 7}") for k in range(390)] + [("user", "end")], 7: [("user", f"t{k % 7}") for k in range(400)]}
    nodes = trie.trie(*rows_of(spark, seqs), local=100)[0]
    assert found_trie(nodes) == plain_trie_of_long(seqs)


def plain_trie_of_long(seqs):
    """plain_trie() with prefixes numbered, so that long ones aren't held."""
    number, last, members, parent = {}, {}, defaultdict(list), {}
    ends = defaultdict(list)
    for c in sorted(seqs):
        at, d = 0, 0
        members[0].append(c)
        for turn in seqs[c]:
            new = number.setdefault((at, turn), len(number) + 1)
            parent[new], last[new] = at, turn
            at, d = new, d + 1
            members[at].append(c)
        ends[at].append(c)
    depth, kids, leaves, saved = {0: 0}, defaultdict(int), defaultdict(int), defaultdict(int)
    for k in sorted(parent):
        depth[k] = depth[parent[k]] + 1
    for k in sorted(members, reverse=True):
        leaves[k] = leaves[k] or 1
        if k:
            saved[k] += (len(members[k]) - 1) * len(WORD.findall(last[k][1]))
            kids[parent[k]] += 1
            leaves[parent[k]] += leaves[k]
            saved[parent[k]] += saved[k]
    return sorted((min(members[k]), depth[k], min(members[parent[k]]) if k else -1, len(members[k]), kids[k], leaves[k], saved[k], hex_of(",".join(map(str, ends[k])))) for k in members)


def test_rebuilt_conversations(spark):
    rng = random.Random(9)
    own = {c: [("user", f"c{c} t{k}") for k in range(rng.randrange(1, 6))] for c in [*range(-25, 45), 1000, 1001, 1019] if c not in (20, 40)}
    data = [(c, k, r, t) for c, s in own.items() for k, (r, t) in enumerate(s)]
    rows, convs = trie.lent(trie.numbered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")))
    seqs = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seqs[c] = own.get(base, [])[:h] + s[h:]
    assert sorted(r["conv"] for r in convs.collect()) == sorted(own) and any(not s for s in seqs.values())
    assert found_trie(trie.trie(rows, convs)[0]) == plain_trie(seqs)


# --- fill in the middle


def plain_middle(doc_id, text):
    d = hex_of(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    t, n = text or "", len(text or "")
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_middle_equals_plain(spark):
    texts = ["", None, "a", "<P", "x<M>y", "S><S", "\r\n é́👩‍👩\x00", "long " * 100_000, "<S><", ">M>" * 30, " \n"]
    docs = [(i if i % 50 else None, texts[i % len(texts)]) for i in range(400)] + [(7, "same"), (7, "same"), (-3, "negative id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("own"), "output": F.lit(1)})
    out = middle.transform(frame)
    assert out.columns == ["doc_id", "text", "n", "output", "fim"]
    rows = out.withColumn("back", middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(rows) == len(docs) and {r["fim"]["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        f = r["fim"]
        assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == plain_middle(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and f["output_sha256"] == hex_of(f["output"]) and r["n"] == "own"
    assert middle.transform(frame.limit(0)).count() == 0


def test_units_are_never_cut(spark):
    how = middle.Middle(unit=r"\X", marks=("⟨pre⟩", "⟨suf⟩", "⟨mid⟩"), plain=0, spm=50, seed="s")
    text = "é" * 5 + "👩‍👩" + "🇫🇷🇩🇪" + "\r\n"
    clusters = regex.findall(r"\X", text)
    rows = middle.transform(spark.createDataFrame([(i, text) for i in range(100)], "doc_id long, text string"), how=how).withColumn("back", middle.restored(F.col("fim.output"), F.col("fim.form"), how)).collect()
    edges = {sum(map(len, clusters[:k])) for k in range(len(clusters) + 1)}
    for r in rows:
        assert r["back"] == text and r["fim"]["n"] == len(clusters) and {r["fim"]["prefix_chars"], r["fim"]["prefix_chars"] + r["fim"]["middle_chars"]} <= edges
    assert {r["fim"]["form"] for r in rows} == {"psm", "spm"}


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("ab", "ba", "<M>"), ("<P>", "x<P>y", "<M>"), ("aba", "<S>", "<M>")])
def test_marks_that_overlap_are_refused(marks):
    with pytest.raises(ValueError, match="overlap"):
        middle.Middle(marks=marks)


def test_queries_return_the_contracts_columns(spark, sf_dir):
    q = queries.queries()
    assert q["op11_substring_dedup"](spark, sf_dir).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert q["op12_conversation_trie"](spark, sf_dir).dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    assert q["op13_fill_in_middle"](spark, sf_dir).dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
