"""run() against the stages in plain Python and against each other."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from guardwalk.llm import bpe, mixing, neardup, quality
from tests.llm.common import docs, empty, listed, prose
from tests.llm.test_free import plain_components
from tests.llm.test_native import plain_spans


def plain_redacted(text):
    """Spans, overlapping ones as one, replaced by the mark."""
    if text is None:
        return None
    out, at = "", 0
    for a, _, b, *_ in plain_spans(text):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def check_secrets(before, after):
    assert Counter((d, plain_redacted(t), s) for d, t, s in rows_of(before)) == Counter(rows_of(after))


def check_mixing(before, after):
    """Rows are those of the stage before, and each source's words meet its target to about its longest document."""
    old, new = rows_of(before), rows_of(after)
    assert set(new) <= set(old)
    words, made, longest = Counter(), Counter(), defaultdict(int)
    for _, t, s in old:
        words[s] += len(neardup.WORD.findall(t or ""))
        longest[s] = max(longest[s], len(neardup.WORD.findall(t or "")))
    for _, t, s in new:
        made[s] += len(neardup.WORD.findall(t or ""))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    goals = mixing.targets([words[s] for s in order], [float(i % 3 + 1) for i in range(len(order))])
    for s, goal in zip(order, goals, strict=True):
        assert abs(made[s] - goal) <= 2 * longest[s], s
    assert all(n <= 3 * Counter(old)[r] for r, n in Counter(new).items())


def check_bpe(before, after):
    import tiktoken

    ranks = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).v.ranks
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t, _ in rows_of(before):
        ids = lib.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(want) == Counter(map(tuple, after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))


CHECKS = {2: check_secrets, 3: check_mixing, 4: check_bpe}


@pytest.mark.parametrize("make", [docs, empty])
def test_odd_documents_in_every_stage(spark, make):
    """Every stage on its own: nulls, empty and long texts, ties, repeated rows, an empty table, clashing columns."""
    table = make(spark)
    if make is docs:
        more = [(100 + i, prose(60, 50 + i) + (" api_key = 'abcdef012345678' " * (i % 3)), "abc"[i % 3], 7, "x", "y", 3, "p", "k", 1, None) for i in range(30)]
        table = table.union(spark.createDataFrame([*more, more[0]], table.schema))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, table, "")
        if i < 4:
            assert got.schema.names == table.schema.names
        if i in CHECKS:
            CHECKS[i](table, got)
        elif i == 1:
            kept = {d for d, _, _, k in plain_components([(d, t) for d, t, _ in rows_of(table) if d is not None], 5) if k}
            assert {r["doc_id"] for r in got.collect()} - {None} == kept
            assert Counter(r for r in rows_of(got) if r[0] is None) == Counter(r for r in rows_of(table) if r[0] is None)
        if make is empty:
            assert got.count() == 0


@pytest.mark.parametrize("make", [docs, empty])
def test_run_on_odd_documents(spark, tmp_path, make):
    make(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert listed(got) == listed(corpus_pipeline.run(spark, str(tmp_path))) and (make is docs or got.count() == 0)


def test_stages_and_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        seen.append(docs)
    rejected = {r["doc_id"] for r in quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet")).filter("NOT kept").collect()}
    assert rejected and not rejected & {r["doc_id"] for r in seen[0].collect()}
    rows = [(r["doc_id"], r["text"]) for r in seen[0].collect()]
    assert {r["doc_id"] for r in seen[1].collect()} == {d for d, _, _, kept in plain_components(rows, 5) if kept}
    for i, check in CHECKS.items():
        check(seen[i - 1], seen[i])
    assert seen[2].count() == seen[1].count() and {r["doc_id"] for r in seen[3].collect()} <= {r["doc_id"] for r in seen[2].collect()}
    assert sorted(r["doc_id"] for r in seen[4].collect()) == sorted(r["doc_id"] for r in seen[3].collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, seen[4].collect()))
