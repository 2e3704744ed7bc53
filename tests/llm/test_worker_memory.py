"""What Python workers keep of texts goes with the task, since tasks of other stages follow in the same workers."""

import tracemalloc

import public_tokenizers as P
import pyarrow as pa

from gradeloom.llm import bpe, quality
from gradeloom.llm.common import forgetful


def test_workers_keep_no_memos_from_task_to_task(spark):
    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    docs = spark.createDataFrame([(i, f"Word{i} and number{i * 7} of some text, again and again") for i in range(400)], "doc_id long, text string").repartition(4)

    def kept(batches):
        import os

        _, ids_of = bpe.coder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"worker": [os.getpid()], "n": [len(ids_of.index) + len(ids_of.encode.memo) + len(quality._buckets)]})

    def left():
        return spark.range(0, 40, 1, 4).mapInArrow(kept, "worker long, n long").collect()

    assert bpe.digests(docs, path, pattern).where("n_tokens > 0").count() == 400
    assert bpe.encode(docs, path, pattern).where("size(ids) > 0").count() == 400
    assert [r.n for r in left() if r.n] == []
    model = quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert quality.score(docs, model).where("score >= 0").count() == 400
    assert [r.n for r in left() if r.n] == []


def test_forgetful_work_gives_all_and_forgets_also_after_errors():
    gone = []

    @forgetful(lambda: gone.append(1))
    def work(batches):
        for b in batches:
            yield 1 // b

    assert list(work(iter([1, 1]))) == [1, 1] and gone == [1]
    try:
        list(work(iter([1, 0])))
    except ZeroDivisionError:
        gone.append("error")
    assert gone == [1, 1, "error"]


def test_encoding_takes_little_memory_whatever_the_words():
    """Beside its vocabulary and the texts, a task holds 60 MB at most on these; it was 165 with larger slices and memos."""
    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}{(i * 50 + k) * 7919 % 999983:x}, so" for k in range(50)) for i in range(8_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8_000)), "text": texts})
    _, ids_of = bpe.coder(path, pattern)
    ids_of.forget()
    tracemalloc.start()
    try:
        n = sum(sum(part.column("n_tokens").to_pylist()) for part in bpe.digested(iter([batch]), path, pattern, "doc_id", "text", False))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        ids_of.forget()
    assert n > 8_000 * 100 and peak < 100e6


def test_long_pieces_need_no_table_of_pairs():
    """Pairs are looked up by the bytes that they make, with the result of the pair table of short pieces."""
    tree, _ = bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert not [k for k, v in vars(tree).items() if isinstance(v, dict) and k != "ranks"]
    pieces = [b"a", b"ab", b"internationalisation", b" the" * 9, b"=" * 64, "Stra\u00dfe\u4e2d\u6587".encode() * 3, bytes(range(32, 96)), b"x1" * 31]
    few = [p for p in pieces if p not in tree.ranks]
    assert [tree.merge_one(p) for p in few] == [tree._merge_rows([p], max(2, 1 << (len(p) - 1).bit_length()))[0] for p in few]
