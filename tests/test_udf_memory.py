"""Python objects of the Arrow UDFs follow a few rows, not the batch."""

import tracemalloc

import pyarrow as pa

from corpuskit.functions import python_udfs as U


def _peak_mb(udf, *columns):
    udf.func(*[c.slice(0, 1) for c in columns])  # imports and caches first
    tracemalloc.start()
    try:
        out = udf.func(*columns)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


TEXTS = pa.array([f"the Ünïon – of the {i} " * 500 for i in range(1000)])  # some 11 MB


def test_protecting_and_restoring_a_batch():
    texts = pa.array([f"the {i} " * 100 for i in range(1000)])  # 100,000 terms
    protect = U.protect_terms_udf(["the"])
    out, peak = _peak_mb(protect, texts)
    assert peak < 6
    back, peak = _peak_mb(U.restore_terms, out.field("text"), out.field("terms"))
    assert peak < 6 and back.equals(texts)
    terms = pa.array([["the"]] * len(texts))
    listed, peak = _peak_mb(U.protect_listed, texts, terms)
    assert peak < 6 and listed.equals(out)


def test_normalising_a_batch():
    for udf in (U.nfkc, U.casefold, U.unescape_html):
        out, peak = _peak_mb(udf, TEXTS)
        assert peak < 8 and len(out) == len(TEXTS)


def test_nulls_and_empty_batches():
    none, empty = pa.array([None, "", "x"]), pa.array([], pa.string())
    for udf in (U.nfkc, U.casefold, U.unescape_html):
        assert udf.func(none).to_pylist() == [None, "", "x"] and len(udf.func(empty)) == 0
    protect = U.protect_terms_udf(["the"])
    assert protect.func(none).to_pylist() == [{"text": t, "terms": []} for t in ("", "", "x")] and len(protect.func(empty)) == 0
    sliced = protect.func(pa.array(["the a the", None, "b the"])).slice(1)
    assert U.restore_terms.func(sliced.field("text").slice(0), pa.array(sliced.field("terms").to_pylist())).to_pylist() == ["", "b the"]
    assert U.restore_terms.func(none, pa.array([None, [], None], sliced.type.field("terms").type)).to_pylist() == [None, "", "x"]
