"""What a worker makes Python objects of at a time: a slice of an Arrow batch, not the batch."""

import tracemalloc

import pyarrow as pa

from loomspan.functions import text as T
from loomspan.operators import responses
from loomspan.sources import strict


def _peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_repaired_bodies_are_objects_by_slices():
    bodies = pa.array(['["he said "no" and left"]' + " " * 100_000] * 200 + [None])
    out = []
    assert _peak(lambda: out.extend(T.repaired_json.func(iter([bodies])))) < 8_000_000  # the batch has 20 MB
    assert len(out) == 1 and len(out[0]) == 201 and out[0][200].as_py() is None
    assert out[0][0].as_py().strip() == '["he said \\"no\\" and left"]'


def test_only_broken_bodies_are_sent_to_python(spark):
    raw = spark.createDataFrame([("a", '[{"id": "u", "runs": []}]'), ("b", '{"note": "he said "no"", "data": []}'), ("c", None)], "batch string, body string")
    got = {r["batch"]: (r["rows"] is None, r["repaired"]) for r in responses.decoded(raw).collect()}
    assert got == {"a": (False, False), "b": (False, True), "c": (True, False)}
    plan = responses.decoded(raw)._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("repaired_json(") :].split("\n")[0]
    assert sent.startswith("repaired_json(CASE WHEN") or "_broken" in sent


def test_documents_are_read_one_by_one(spark):
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["<p>a</p>", None, "<p>b</p>"])], ["id", "html"])
    assert [b.num_rows for b in strict._documents(iter([batch]))] == [1, 1, 1]
    pages = spark.createDataFrame([(i, f"<p>a{i}</p>" if i % 5 else None) for i in range(40)], "id long, html string").coalesce(1)
    slots = strict.node_slots(pages, "id")
    assert slots.count() == 32
    new = slots.selectExpr("id", "node", "upper(text) AS target")
    got = {r["id"]: (r["html"], r["fault"]) for r in strict.rendered_by_node(pages, new, "id").collect()}
    assert got == {i: (f"<p>A{i}</p>" if i % 5 else None, None) for i in range(40)}
