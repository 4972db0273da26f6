"""Each operator against a brute-force version, on small rows that hold nulls, empty texts, ties and repeats."""

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vesper.llm import components, language, mixing, neardup, packing, quality, search, secrets, substring, warc
from vesper.llm import html as pages_html
from vesper.llm.html_training import labelled_pages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOCS)


def clashing(df):
    """Columns that operators use inside, with values they mustn't pick up."""
    names = ("text_", "row", "base", "more", "spans", "size", "rep", "anchor", "doc", "token", "family", "shingles", "_rank", "_copies", "lang_pred", "score", "id", "_html_", "n_words", "component_id", "dims")
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


# --- 1 repeated substrings


def substring_brute(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts.values() for p in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        cover = np.zeros(len(t) + 2, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cover[p + 1 : p + 1 + length] = 1
        kept = bytes(b for b, c in zip(t, cover[1:], strict=False) if not c)
        out[d] = (len(t), len(t) - len(kept), int((np.diff(cover) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_substring_removal(spark, block):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(150, 700))) for _ in range(8)]
    texts = {}
    for i in range(70):
        t = "".join(b[rng.randint(0, 200) :][: rng.randint(100, 500)] + "xyz"[: rng.randint(0, 3)] for b in rng.choices(base, k=rng.randint(0, 4)))
        texts[i] = "a" * rng.randint(150, 700) if i % 17 == 0 else "ab" * rng.randint(90, 250) if i % 19 == 0 else t
    texts |= {100: base[0], 101: base[0], 102: base[0]}
    rows = [(i, t) for i, t in texts.items()] + [(200, None), (201, "")]
    found = {r["doc_id"]: r for r in substring.deduplicate(clashing(docs(spark, rows)), block=block).collect()}
    for d, e in substring_brute({i: (t or "").encode() for i, t in rows}, 200).items():
        r = found[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == e, d
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"] and len(r["removed"]) == r["n_spans"]


def test_column_wise_windows():
    rng = random.Random(3)
    for _ in range(30):
        passages, lead = [], []
        for _ in range(rng.randint(2, 10)):
            left = rng.randint(0, 8)
            lead.append(left)
            passages.append(bytes(rng.choice(b"ab") for _ in range(left)) + b"abba" + bytes(rng.choice(b"ab") for _ in range(rng.randint(max(0, 8 - left), 10))))
        found = substring.repeated_windows(passages, np.array(lead), 12)
        for i, p in enumerate(passages):
            for c in range(found.shape[1]):
                at = c - max(lead)
                w = lambda k: passages[k][at + lead[k] :][:12] if at + lead[k] >= 0 else b""  # noqa: E731, B023
                assert found[i, c] == (len(w(i)) == 12 and any(w(j) == w(i) for j in range(len(passages)) if j != i))


def test_substring_no_rows_and_repeated_rows(spark):
    assert substring.deduplicate(docs(spark, [])).count() == 0
    t = "".join(random.Random(1).choices("abcdef", k=300))
    assert [r["n_removed"] for r in substring.deduplicate(docs(spark, [(1, t), (1, t)])).collect()] == [300, 300]


def test_substring_null_and_repeated_ids(spark):
    rng = random.Random(2)
    a, b, c = ("".join(rng.choices("abcdef", k=300)) for _ in range(3))
    rows = [(None, a), (None, b + a), (7, b), (7, c), (8, "x" + c[:250]), (None, None)]
    found = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substring.deduplicate(docs(spark, rows)).collect())
    assert found == {(None, 300, 300): 1, (None, 600, 600): 1, (7, 300, 300): 1, (7, 300, 250): 1, (8, 251, 250): 1, (None, 0, 0): 1}


# --- 2 quality rules


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)) for _ in range(n)) + "."
    line = " ".join(word() for _ in range(12)) + "."
    rows = [(i, prose(12)) for i in range(40)] + [(100 + i, " ".join(word() + "###" for _ in range(60))) for i in range(4)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "\n".join([line] * 6)), (205, "x " * 40), (206, "a\x0bb\x0cc é😀 " * 9), (300, rows[0][1]), (300, rows[0][1])]
    out = quality.judge(clashing(docs(spark, rows))).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        t = texts[r["doc_id"]] or ""
        words = WORD.findall(t)
        grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])
        if r["doc_id"] < 100 or r["doc_id"] == 300:
            assert r["kept"]
        if 100 <= r["doc_id"] < 104:
            assert not r["kept"]
    assert quality.judge(docs(spark, [])).count() == 0


def test_em_recovers_rates(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.8
        rows.append(tuple(-1 if rng.random() < (0.01 if good else 0.6) else 1 for _ in range(4)))
    p = quality.fit(spark.createDataFrame(rows, "a int, b int, c int, d int"), ["a", "b", "c", "d"], rounds=60, strength=0.002)
    assert abs(p["prior"] - 0.8) < 0.05
    assert all(p[n][0] < 0.03 and abs(p[n][1] - 0.6) < 0.1 for n in "abcd")


# --- 3 main text


def test_crf_on_held_out_layouts():
    model = pages_html.default_model()
    right = total = 0
    for found, labels in labelled_pages(150, seed=1234):
        right += sum(a == b for a, b in zip(model.decode(pages_html.features(found)), labels, strict=True))
        total += len(labels)
    assert right / total > 0.99


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    model = pages_html.Crf(rng.normal(size=(8, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 7):
        page = [[int(x) for x in rng.integers(0, 8, 3)] for _ in range(n)]
        score = lambda y: model.start[y[0]] + sum(model.emit[f].sum(axis=0)[a] for f, a in zip(page, y, strict=True)) + sum(model.move[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        assert model.decode(page) == list(max(itertools.product((0, 1), repeat=n), key=score))


def test_html_extraction(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in pages_html.extract(clashing(df)).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_html_edges(spark):
    rows = [(1, None), (2, ""), (3, "<nav><a href=x>y</a></nav>"), (4, "<p>a<p>b</div></p><!-- x"), (5, "<" * 2000 + "a b=" * 2000), (6, "<div>" * 3000 + "x"), (7, "<script>if (a < b) '</p>'</script>"), (4, "<p>a<p>b</div></p><!-- x")]
    out = pages_html.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 8 and by[1] == by[2] == by[3] == by[7] == ""
    assert pages_html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    names = [b.text() for b in pages_html.blocks("<p>x &amp;\n  y<br>z &eacute;</p><ul><li>one<li>two</ul>")]
    assert names == ["x & y z é", "one", "two"]


def test_open_heads_and_many_unclosed_tags():
    blocks = lambda page: [(b.path, b.text()) for b in pages_html.blocks(page)]
    assert blocks("<html><head><title>x</title><body><article><p>one</article>") == [(("html", "body", "article", "p"), "one")]
    assert blocks("<head><meta charset=u><script>s</script><link href=x><div>one</div>two") == [(("div",), "one"), ((), "two")]
    assert blocks("<head><title>x</title> one") == [((), "one")]
    assert blocks("<head><noscript>x<img src=y></noscript><body>one") == [(("body",), "one")]
    assert blocks("<head><title>x</title></head><body>one") == [(("body",), "one")]
    for n in (10, 254, 255, 1000, 20000):
        assert blocks(f"<article><div class=side>{'<b>' * n}one</div><p>two</article>three") == [(("article", "div"), "one"), (("article", "p"), "two"), ((), "three")]
        assert blocks(f"<ul><li>{'<font>' * n}one<li>two</ul><p>{'<i>' * n}three<p>four") == [(("ul", "li"), "one"), (("ul", "li"), "two"), (("p",), "three"), (("p",), "four")]


# --- 4 language


def test_language_accuracy_on_held_out(spark, sf_dir):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(df.where(language.remainder() != 2))
    out = language.identify(df.withColumn("held", language.remainder() == 2), model).where("held").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_kernel_scores_equal_their_definition():
    texts = [("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), ("the dog and the fox", "en"), ("la vache et le chien", "fr")]
    model = language.train(texts, landmarks=2, ridge=1e-2)
    grams = lambda t: {int(x) for s in language._slots(t, language.ORDERS) for x in s}
    marks = [grams(t) for lang in ("en", "fr") for t, x in texts if x == lang]
    universe = set().union(*marks)
    kernel = lambda a, b: len(a & b & universe) / math.sqrt(len(a & universe) * len(b & universe))
    between = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(between)
    root = vectors / np.sqrt(values)
    x = np.array([[kernel(grams(t), m) for m in marks] for t, _ in texts]) @ root
    y = np.array([[1.0 if lang == want else -1.0 for want in ("en", "fr")] for _, lang in texts])
    c = x - x.mean(axis=0)
    solved = np.linalg.solve(c.T @ c + 1e-2 * 4 * np.eye(4), c.T @ (y - y.mean(axis=0)))
    expected = c @ solved + y.mean(axis=0)
    assert np.allclose(model.scores([t for t, _ in texts]), expected, atol=1e-3)


def test_language_edges(spark):
    model = language.train([("the cat", "en"), ("le chat", "fr")])
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the cat " * 50000), (5, "le chat"), (5, "le chat")]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(clashing(docs(spark, rows)), model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == "en" and out[5][0] == "fr"
    assert language.identify(docs(spark, []), model).count() == 0
    assert language.fit(docs(spark, [(1, None, "en")])).langs == ()
    assert language.identify(docs(spark, [(1, "abc")]), language.fit(docs(spark, []))).first()["lang_pred"] == "und"


def test_languages_of_copies_are_learned(spark):
    """Copies of a text pass or fail the draw together: what counts is the number of different texts."""
    rows = [(i, f"ko te reo {'abcdefghij'[i % 10]} taonga", "mi") for i in range(20000)] + [(10**6 + i, "le chat est sur le tapis", "fr") for i in range(10000)]
    rows += [(2 * 10**6 + i, f"the cat {i}", "en") for i in range(2000)]
    drawn = collections.Counter(lang for _, lang in language.sample(docs(spark, rows)))
    assert drawn == {"mi": 10, "fr": 1, "en": 300}
    assert collections.Counter(lang for _, lang in language.sample(docs(spark, rows), per_language=3)) == {"mi": 3, "fr": 1, "en": 3}


# --- 5 near-duplicates


def neardup_brute(rows, percent=85):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    family = rng.choices(vocabulary, k=120)
    rows = []
    for i in range(90):
        w = list(family) if i < 60 else rng.choices(vocabulary, k=rng.randint(1, 150))
        for _ in range(rng.randint(0, 6) if i < 60 else 0):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "a b"), (205, "a  B"), (206, rows[70][1]), (207, " \n"), (300, " ".join(rng.choices(vocabulary, k=20000)))]
    expected = neardup_brute(rows)
    for block in (7, 256):
        monkeypatch.setattr(neardup, "SIGN_BLOCK", block)
        monkeypatch.setattr(neardup, "SET_BLOCK", block)
        out = {r["doc_id"]: r for r in neardup.near_duplicates(clashing(docs(spark, rows))).collect()}
        assert {d: (r["n_shingles"], r["component_id"]) for d, r in out.items()} == expected
        assert all(r["kept"] == (d == r["component_id"]) for d, r in out.items())
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in neardup.near_duplicates(docs(spark, [(1, "a b c d"), (1, "a b c d")])).collect()] == [1, 1]


def test_postings_prefix_keeps_every_pair(spark):
    """Two signatures that agree in MATCHES coordinates share a posting, whichever values are frequent."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, neardup.COORDINATES, dtype=np.uint32)
    rows = []
    for i in range(20):
        b = a.copy()
        b[rng.permutation(neardup.COORDINATES)[: neardup.COORDINATES - neardup.MATCHES]] = rng.integers(0, 1 << 32, neardup.COORDINATES - neardup.MATCHES, dtype=np.uint32)
        rows.append((i + 1, bytearray(b.tobytes())))
    df = spark.createDataFrame([(0, bytearray(a.tobytes())), *rows], "rep long, sign binary")
    tokens = neardup._tokens(a.astype(np.uint64)[None])[0]
    posted = collections.defaultdict(set)
    for r in neardup.postings(df, {int(t): 1000 + i for i, t in enumerate(tokens[::2])}).collect():
        posted[r["rep"]].add(r["token"])
    assert all(posted[0] & posted[i] for i in range(1, 21))


def test_matches_follow_from_percent(spark):
    miss = lambda m, p: sum(math.comb(32, k) * p**k * (1 - p) ** (32 - k) for k in range(m))
    assert neardup.least_matches(85) == neardup.MATCHES and neardup.least_matches(100) == 32
    for percent in range(40, 100):
        m = neardup.least_matches(percent)
        assert miss(m, percent / 100) <= neardup.MISS < miss(m + 1, percent / 100)
    with pytest.raises(ValueError):
        neardup.least_matches(20)
    rng = random.Random(4)  # pairs of similarity a little over 0.5: texts of 100 shingles, and copies with 98 more
    rows = []
    for i in range(0, 80, 2):
        w = [f"{i}w{k}" for k in range(200)]
        rows += [(i, " ".join(w[:102])), (i + 1, " ".join(w))]
    rng.shuffle(rows)
    out = neardup.near_duplicates(docs(spark, rows), percent=50).collect()
    assert [r["doc_id"] for r in out if r["kept"] != (r["doc_id"] % 2 == 0)] == []


def test_components(spark):
    rng = random.Random(6)
    for n, m in ((2, 1), (30, 20), (60, 70)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n + i, n + i + 1) for i in range(12)]
        parent = list(range(n + 13))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        nodes = {x for e in edges if e[0] != e[1] for x in e}
        out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert out == {x: root(x) for x in nodes}
        a, b = (np.array(x) for x in zip(*edges, strict=True))
        assert components.local_components(n + 13, a, b).tolist() == [root(x) for x in range(n + 13)]


# --- 6 mixing


def test_mixing_targets_and_limits(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), None, rng.choice(["a", "a", "a", "b", "é", None, "z"])) for i in range(800)] + [(900, None, None, "q"), (901, "x y", None, "tiny")]
    out = mixing.mix(clashing(docs(spark, rows))).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert {r["doc_id"]: r["taken"] for r in out} == again and len(out) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in out:
        assert r["size"] == len(WORD.findall(dict((x[0], x[1]) for x in rows)[r["doc_id"]] or "")) and r["taken"] <= 3 * r["size"]
        size[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:  # share, cap, share the rest again
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        share = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        more = {s for s in order if s not in capped and share[s] >= 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in order:
        assert target[s] == pytest.approx(share[s])
        assert abs(taken[s] - share[s]) <= 60
    assert sum(taken.values()) <= sum(size.values())


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [(r["size"], r["taken"]) for r in mixing.mix(docs(spark, [(1, None), (2, "")])).collect()] == [(0, 0), (0, 0)]
    assert sorted(r["taken"] for r in mixing.mix(docs(spark, [(1, "a b", None, "s"), (1, "a b", None, "s")])).collect()) == [2, 2]


def test_mixing_of_one_long_document_equals_sql(spark, tmp_path):
    """A source of one document, whose virtual finish time is 5."""
    rows = [(i, "w " * 10, None, "a") for i in range(400)] + [(1000 + i, "w " * 10, None, "b") for i in range(100)] + [(5000, "w " * 10000, None, "c")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    at = [c[0] for c in con.execute(mixing.SQL_OP6).description]
    assert out == {r[at.index("doc_id")]: r[at.index("taken")] for r in con.fetchall()}
    assert out[5000] == 0 and sum(out.values()) <= 15000


def test_mixing_of_many_sources_equals_sql(spark, tmp_path):
    """A thousand sources, most of one document, so that copies finish together; more sources than ranges."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([0, 3, 3, 7]), None, f"host{i % 1000 if i < 1200 else 7}") for i in range(2000)] + [(3000, "w w", None, None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    df = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL_OP6})").fetchall()}
    assert {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in df.collect()} == expected
    assert 0 < sum(r[3] for r in expected.values()) <= sum(r[0] for r in expected.values())


def test_mixing_null_and_repeated_ids(spark):
    rows = [(None, f"{i} " * (i % 7 + 1), None, "ab"[i % 2]) for i in range(60)] + [(5, "x y z", None, "a"), (5, "x", None, "a"), (5, "x", None, "a")]
    df = docs(spark, rows).coalesce(1).withColumn("row", F.monotonically_increasing_id())
    out = mixing.mix(df, key_col="row").collect()
    assert sorted(r["row"] for r in out) == list(range(63)) and all(r["size"] == len(rows[r["row"]][1].split()) for r in out)
    assert sum(r["taken"] for r in out) > 0.9 * sum(r["size"] for r in out) and sum(r["copies"] > 0 for r in out if r["doc_id"] is None) > 30


# --- 7 packing


def test_tokens_and_pieces(spark):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", None, "Hello, WORLD. it's ABC123 don't!!", "İstanbul ΣΑΣ οδός é", "a\x1cb c d", "x <|endoftext|> y;", "lorem ipsum dolor. " * 3000, "a.b, c: d", "x y", "x y"]
    out = packing.pieces(clashing(docs(spark, list(enumerate(texts)))), with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by[i], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in mine) == ids.tobytes()
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] <= 2048 and r["ids_crc32"] == zlib.crc32(part.tobytes())


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 15))}
        rows = packing.plan(counts, 64)
        bins = []
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            fits = [b for b in bins if b[0] >= length]
            if fits:
                min(fits)[0] -= length
            else:
                bins.append([64 - length])
        used = collections.defaultdict(list)
        for length, n in counts.items():
            mine = sorted(r for r in rows if r[0] == length)
            for rank in range(n):
                _, first, sequence, per, offset = max(r for r in mine if r[1] <= rank)
                used[sequence + (rank - first) // per].append((offset + (rank - first) % per * length, length))
        assert len(used) == len(bins)
        for slots in used.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= 64


def test_packing_is_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "a " * rng.choice([1, 5, 5, 5, 700, 1500, 5000])) for i in range(300)] + [(400, None), (1, "a " * 5)]
    out = packing.pack(packing.pieces(docs(spark, rows))).collect()
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = [r["length"] for r in out]
    # none of 701 or more goes beside one of 1501 or more, and only two of them fit together
    assert len(sequences) == sum(n > 1024 for n in lengths) + math.ceil(sum(700 < n <= 1024 for n in lengths) / 2)
    assert packing.pack(packing.pieces(docs(spark, []))).count() == 0


# --- 8 secrets


def test_secret_patterns(spark):
    key = "AKIA" + "Z" * 16
    texts = ["", None, 'Token = "24be64439e3e49cf46b2d7c90f3602a3"', f"x {key} AKIA12 AKIAAKIA{'Q' * 12}", "token=secret: abcdefghijklmnop", "PASSWORD:hunter2 api_key='Aa0+/=._-Aa0+/=' apikey=ABCDEFGHIJKLMNOP", "é😀 deadbeefdeadbeef 0123456789abcdef0 abc", "secret " * 300 + "passwd: 'abcdefghijkl'", "dGhpcyBpcyBhIHNlY3JldCBrZXkgMTIzNDU2Nzg5", "a1B2" * 40, "x" * 100000, "tokentoken=abcdefghijkl", key, key]
    rules = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), "access": (r"AKIA[A-Z0-9]+", 18, 0), "hex": (r"[0-9a-f]+", 16, 0)}
    out = secrets.digest(docs(spark, list(enumerate(texts)))).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, (p, least, group)) in enumerate(rules.items()) for m in re.finditer(p, texts[r["doc_id"]] or "", re.A) if len(m.group(group)) >= least)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (r, joined)
        assert [s for s in r["spans"].split(",") if not s.startswith("entropy")] == (joined.split(",") if joined or not r["spans"] else [])


def entropy_brute(s, width=20):
    width = min(width, len(s))
    windows = [collections.Counter(s[i : i + width]) for i in range(len(s) - width + 1)] if s else []
    return max((-sum(c / width * math.log2(c / width) for c in w.values()) for w in windows), default=0.0)


def test_sliding_entropy_equals_its_definition(spark):
    rng = random.Random(3)
    texts = ["", "a", "aaaa", "ab" * 30] + ["".join(rng.choices("abcdefghij0123456789ABCDEF", k=rng.randint(1, 80))) for _ in range(40)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.max_entropy(F.col("t")).alias("e")).collect():
        assert r["e"] == pytest.approx(entropy_brute(r["t"]), abs=1e-9)


def test_random_strings_found_and_plain_ones_left(spark):
    random_ones = ["zR8kQ2mVx7LpT4nWc9Jb", "9f3a7c1e5b2d8064FA7C", "q7w8e9r0t1y2u3i4o5p6a7s8"]
    plain = ["internationalisation", "550E8400-E29B-41D4-A716-446655440000", "report-final-version-2021-03-04", "example" + random_ones[0], "a" * 40, "1234567890123456789012345", "/usr/share/local/lib/python3", "0123456789ABCDEFGHIJ"]
    out = {r["doc_id"]: r["spans"] for r in secrets.digest(docs(spark, list(enumerate(random_ones + plain)))).collect()}
    assert [i for i, s in out.items() if "entropy" in s] == [0, 1, 2]


def test_words_of_a_path_excuse_only_themselves(spark):
    key, other = "zR8kQ2mVx7LpT4nWc9Jb", "Yt5Hq1sDw3GzUe6Ko0Xi"
    texts = {
        f"https://discord.com/api/webhooks/123456789012345678/{key}": [key],
        f"see /usr/share/example/{key}/lib": [key],
        f"/home/user/sample-{key}/{other}": [other],
        f"{key}/{other}": [f"{key}/{other}"],
        f"com/{key[:11]}/{other[:11]}": [f"{key[:11]}/{other[:11]}"],
        f"é {key}/example/{other}== ok": [key, f"{other}=="],
        "/usr/share/local/lib/python3/site-packages": [],
        "src/main/java/MyProject/TestHelper/SomeOther": [],
        "api/items/550e8400-e29b-41d4-a716-446655440000/name": [],
    }
    for r in secrets.digest(docs(spark, list(enumerate(texts)))).collect():
        text = list(texts)[r["doc_id"]]
        spans = [s.split(":") for s in r["spans"].split(",") if s.startswith("entropy")]
        assert [text[int(a) : int(b)].removeprefix("123456789012345678/") for _, a, b in spans] == texts[text], r


def test_redaction_and_other_columns(spark):
    rows = [(1, "a token=abcdefghijklmnop b deadbeefdeadbeef c"), (2, "clean"), (3, None), (4, "token=deadbeefdeadbeef")]
    out = {r["doc_id"]: r for r in secrets.redact(clashing(docs(spark, rows))).collect()}
    assert out[1]["text"] == "a [SECRET] b [SECRET] c" and out[2]["text"] == "clean" and out[3]["text"] is None and out[4]["text"] == "[SECRET]"
    assert out[1]["spans"] == "clash" and out[1]["base"] == "clash"
    assert secrets.scan(docs(spark, [])).count() == 0


# --- 9 WARC


def test_warc_round_trip(spark, tmp_path):
    big, same = "é<p>" * 60000, "s" * 1000
    rows = [(1, "http://a", big), (2, "http://b", same), (3, None, same), (4, "u\r\nX: y", "t" * 999), (5, "", "t" * 999), (6, "u", None), (7, "u", ""), (8, "u", big), (8, "u", big), (9, "u", "\r\n\r\nWARC/1.0\r\n\r\n")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    manifest = warc.archive(df, str(tmp_path / "w"))
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    table = warc.read(spark, manifest, chunk=4096).collect()
    payload = collections.defaultdict(dict)
    for r in table:
        assert r["data"] is not None and len(r["data"]) <= 4096 and (r["intact"] is True) == r["last"]
        payload[r["record_id"]][r["chunk"]] = bytes(r["data"])
    texts = {i: (h or "").encode() for i, _, h in rows}
    kinds = {r["record_id"]: (r["record_type"], r["refers_to"]) for r in table}
    assert kinds[1] == ("revisit", 8) and kinds[2] == ("revisit", 3) and all(kinds[i] == ("response", None) for i in (3, 4, 5, 6, 7, 8, 9))
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert b"".join(payload[i][k] for k in sorted(payload[i])) == texts[i]
    assert {r["record_id"]: (r["payload_bytes"], r["payload_digest"]) for r in table} == {i: (len(t), hashlib.sha1(t).hexdigest()) for i, t in texts.items()}
    assert warc.read(spark, warc.archive(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_warc_damage_is_found(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string")
    manifest = warc.archive(df, str(tmp_path / "w"))
    path = manifest.first()["archive"]
    raw = gzip.open(path).read()
    with open(path, "wb") as f:
        f.write(gzip.compress(raw.replace(b"hello", b"jello")))
    row = warc.read(spark, manifest).first()
    assert row["intact"] is False and bytes(row["data"]) == b"jello"


# --- 10 search


def top_k_brute(rows, k, every):
    fine = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in fine.items():
        if q % every == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine.items() if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize(("shard", "block", "low"), [(16384, 2048, -1.0), (40, 3, -1.0), (25, 2, 0.0)])
def test_top_k(spark, shard, block, low):
    rng = random.Random(7)
    values = lambda: [rng.uniform(low, 1) if rng.random() < 0.4 else 0.0 for _ in range(24)]
    rows = [(i, values()) for i in range(200)] + [(300 + i, [0.5] * 24) for i in range(30)] + [(400, None), (401, []), (402, [None] * 24), (405, [math.nan] * 24), (410, [math.inf] * 24), (420, [0.0] * 24), (421, [1.0] * 5)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    exact = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    out = search.top_k(df, F.col("vec_id") % 5 == 0, shard=shard, block=block)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()} == top_k_brute(exact, 5, 5)


def test_top_k_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert search.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).count() == 0
    assert search.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 5 == 0).count() == 0
    assert [(r["vec_id"], r["score"]) for r in search.top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [0.5])], schema), F.col("vec_id") % 5 == 0).orderBy("rank").collect()] == [(1, 32768), (2, 32768)]
