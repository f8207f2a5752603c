import re
from collections import Counter, defaultdict
from itertools import accumulate

import corpus_pipeline
import public_tokenizers
import pytest

from odd_rows import ODD
from tablelore.llm import disclosure, packing, toxicity, words
from test_near import plain as plain_groups

SF = "/root/testdata/sf0.001"


def whole(before, after):
    """Pieces hold all tokens of their texts, and sequences are filled without gaps up to their capacity."""
    library = words.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    lengths, sequences = Counter(), defaultdict(list)
    for r in after:
        lengths[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(lengths[i] == len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in before.items())
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [0, *accumulate(n for _, n in places[:-1])] and sum(n for _, n in places) <= packing.CAPACITY


def test_every_stage_against_plain_loops(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        after = made.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            expected = {i for i, r in before.items()
                        if toxicity.probability(toxicity.evidence(r.text or "", model)[1], model) < toxicity.THRESHOLD}
            assert {r.doc_id for r in after} == expected
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or ""), i)
            assert {r.doc_id for r in after} == set(first.values())
        if name == "near_dedup":
            assert {r.doc_id for r in after} == {i for i, _, _, kept in plain_groups([(i, r.text) for i, r in before.items()], 5, 80) if kept}
        if name == "personal_data":
            assert {r.doc_id for r in after} == set(before)
            assert not any(disclosure.base_spans(r.text) for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "packing":
            assert {r.doc_id for r in after} == set(before)
            whole(before, after)
        else:
            assert made.columns == columns
        docs = made


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert set(corpus_pipeline.run(spark, SF).columns) >= {"doc_id", "piece", "sequence_id", "offset"}


@pytest.mark.parametrize("rows", [ODD + [(20, "a@b.org and a@b.org"), (None, "c@d.org")], []])
def test_odd_and_no_rows_and_columns_with_the_names_of_helpers(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, blob string, class string, digest string, _kept int, _digest int, c0 int"
    made = [(i, t, None, None, None, "b", "c", "d", 1, 2, 3) for i, t in rows]
    docs = spark.createDataFrame(made, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1), (6, 0, 0), (None, 1, None), (1, 0, 0)][:len(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= {i for i, _ in rows} and bool(packed) == bool(rows)
