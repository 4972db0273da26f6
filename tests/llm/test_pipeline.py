"""The pipeline against a plain version of its stages."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
from test_operators import neardup_brute

import corpus_pipeline
from vesper.llm import language, packing, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = ((r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))


def redacted(text):
    spans = sorted((m.start(), m.end()) for p, least, group in RULES for m in re.finditer(p, text) if len(m.group(group)) >= least)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], secrets.MARK]
        at = max(at, b)
    return "".join(out) + text[at:]


def mixed(rows, limit=3):
    """doc_id to copies, by serving the queues one document at a time."""
    size = {d: len(WORD.findall(t)) for d, t, _ in rows}
    total = collections.Counter()
    for d, _, s in rows:
        total[s] += size[d]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(limit * total[s] for s in capped)
        share = {s: limit * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        more = {s for s in order if s not in capped and limit * total[s] <= share[s]}
        if not more:
            break
        capped |= more
    items = []
    for s in order:
        cum = 0
        for d in sorted((d for d, _, x in rows if x == s), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
            cum += size[d]
            items += [((e * total[s] + cum) / share[s], order.index(s), hashlib.md5(str(d).encode()).hexdigest(), d, e) for e in range(limit) if size[d]]
    copies, used = collections.Counter(), 0
    for *_, d, _ in sorted(items):
        used += size[d]
        if used > sum(total.values()):
            break
        copies[d] += 1
    return copies


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = random.Random(11)
    lexicon = {"en": ["the", "and", "thing", "that", "which", "would"], "de": ["der", "und", "nicht", "schon", "über", "wir"]}
    rows = []
    for i in range(160):
        lang = rng.choice(("en", "de"))
        text = " ".join(rng.choice(lexicon[lang]) + rng.choice(("", "", "er", "ing", "en")) for _ in range(rng.randint(3, 80)))
        if i % 9 == 0:
            text += " token = " + "".join(rng.choices("abcdef0123456789", k=24)) + " ok"
        if i % 7 == 0 and i:
            text = rows[i - 1][1]
        rows.append((i, text, lang, rng.choice(("a", "b", "c", None)), None))
    rows += [(500, None, "en", "a", 0), (501, "123 ...", "en", "b", 7), (502, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language.fit(docs.where(language.remainder() != 2))
    langs, scores = model.predict([r[1] for r in rows])
    rows = [r for r, lang, score in zip(rows, langs, scores, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_SCORE]
    assert len(rows) == 160
    components = neardup_brute([r[:2] for r in rows])
    rows = [(r[0], redacted(r[1]), r[3]) for r in rows if components[r[0]][1] == r[0]]
    assert any(secrets.MARK in t for _, t, _ in rows)
    copies = mixed(rows)

    encode = packing.WordTokens(packing.tokenizer_path())
    expected = collections.Counter()
    for d, t, _ in rows:
        ids = np.append(np.frombuffer(next(iter(encode([t]))), "<u4"), 0).astype("<u4")
        for k in range(0, len(ids), 2048):
            expected[(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))] += copies[d]
    found = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    assert found == +expected
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]


def test_unknown_languages_and_letter_junk_are_rejected(spark):
    import duckdb

    clean = duckdb.sql("SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang <> 'fr' AND n_chars > 300 ORDER BY doc_id").fetchall()
    strange = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang = 'fr' AND n_chars > 300 ORDER BY doc_id").fetchall()
    rng = random.Random(3)
    held = [i for i in range(10**6, 10**6 + 2000) if zlib.crc32(str(i).encode()) % 4 == 2]  # not learned from
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(40)) for _ in range(100)]
    odd = {i: t for i, t in zip(held, junk + [t for (t,) in strange[:100]], strict=False)}
    docs = spark.createDataFrame(clean + [(i, t, None, "a", len(t)) for i, t in odd.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").select("doc_id").collect()}
    assert len(odd) == 200
    assert not any(i in kept for i in list(odd)[:100])  # junk
    assert sum(i in kept for i in list(odd)[100:]) <= 20  # French, where no French was learned
    assert sum(r[0] in kept for r in clean) >= 0.99 * len(clean)
    one = spark.createDataFrame([(i, "the cat", "en", "a", 7) for i in range(8)], docs.schema)
    assert corpus_pipeline.identify_language(spark, one, "").count() == 8


def test_copies_with_a_fifth_more_text_are_near_duplicates(spark):
    rows = []
    for i in range(0, 40, 2):
        w = [f"{i}w{k}" for k in range(244)]
        rows += [(i, " ".join(w[:204]), "en", "a", 0), (i + 1, " ".join(w), "en", "a", 0)]  # 200 of 240 five-word shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    one, two, three, four, five = (" ".join(f"{x}w{k}" for k in range(60)) for x in "abcde")
    rows = [(None, one, "en", "a", 0), (None, two, "en", "a", 0), (3, three, "en", "a", 0), (3, three, "en", "a", 0), (4, four, "en", "b", 0), (4, one, "en", "b", 0), (9, five, "en", "b", 0), (None, five, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(None, two), (3, three), (4, four), (4, one), (9, five)])
    mixed = corpus_pipeline.mix_sources(spark, docs.limit(0).union(spark.createDataFrame([(None, f"{i} b c", None, "s", 0) for i in range(9)], docs.schema)), "")
    assert sorted(r["text"] for r in mixed.collect()) == [f"{i} b c" for i in range(9)]
