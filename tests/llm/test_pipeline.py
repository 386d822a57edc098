import collections
import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece
from test_operators import DOCS, classes_by_hand, none, odd

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_the_columns_and_takes_anything(spark):
    for name, step in corpus_pipeline.STAGES:
        for docs in (odd(spark).select(*[c.split()[0] for c in DOCS.split(", ")]), none(spark)):
            out = step(spark, docs, SF)
            if name != "tokens":
                assert out.dtypes == docs.dtypes, name
            out.collect()


def test_languages_are_learned_from_all_documents(spark):
    """A language whose documents all have one remainder, which no stage holds out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("αβγδεζηθικλμνξοπρστυφχψω"), n)) for n in rng.integers(2, 9, 300)]
    greek = spark.createDataFrame([(i, " ".join(rng.choice(words, 60)), "el", "a", 0) for i in ids], DOCS)
    kept = corpus_pipeline.known_language(spark, docs.select(*greek.columns).union(greek), SF)
    assert len(ids) > 50 and kept.where("lang = 'el'").count() == len(ids)


def shingles(text, k=5):
    w = [x.lower() for x in text.split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_repeats_go_and_nothing_else(spark):
    """Stage 3 by plain means: what goes was in an earlier document, and what an earlier document has in 60 words in a row goes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, docs, SF).collect()}
    seen = set()
    for d in sorted(before):
        left = after[d].text if d in after else ""
        assert d not in after or after[d].n_chars == len(left)
        gone = shingles(before[d]) - shingles(left)
        assert len(gone & seen) >= 0.6 * len(gone) - 8, d  # edges, and paragraphs that are only similar
        words = before[d].split()
        earlier = [all(s in seen for s in shingles(" ".join(words[i : i + 60]))) for i in range(len(words) - 59)]
        if any(earlier):
            assert len(left) < len(before[d]), d
        seen |= shingles(before[d])


def test_mix_is_the_sql_of_its_input(spark, tmp_path):
    import duckdb

    from glintspan.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 != 0")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = collections.Counter()
    for doc, size, _, _, taken in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall():
        if size:
            want[doc] += taken // size
    sizes = {r.doc_id for r in docs.collect() if (r.text or "").split()}
    assert collections.Counter(r.doc_id for r in corpus_pipeline.mixed(spark, docs, SF).collect() if r.doc_id in sizes) == +want


def test_run_against_brute_force(spark):
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r for r in docs.orderBy("doc_id").collect() if any(c.isalpha() for c in r.text or "")]
    first = {i for i, _, c in classes_by_hand([(r.doc_id, r.text) for r in kept]) if i == c}
    assert {i for i, _, _ in got} <= first
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    cut = corpus_pipeline.without_repeats(spark, docs.where(docs.doc_id.isin(*first)), SF)
    mixed = corpus_pipeline.mixed(spark, cut, SF)
    want = collections.Counter()
    for r in mixed.collect():
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] += 1
    assert got == want
