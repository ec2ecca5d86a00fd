"""Extra columns named like an operator's own leave its result as it is."""

import pytest
from pyspark.sql import functions as F

from loomspan.llm.ann_blocks import op1_ann_blocks
from loomspan.llm.bpe_codec import op6_bpe
from loomspan.llm.ogg_media import op7_ogg
from loomspan.llm.separator_scan import op9_separator_scan


@pytest.mark.parametrize(("operator", "names"), [
    (op6_bpe, ["n_tokens", "ids_sha256", "ids", "decoded_sha256"]),
    (op7_ogg, ["feature", "media", "n_bytes", "payload_sha256"]),
    (op9_separator_scan, ["file", "doc_no", "n_tokens", "width", "block", "length"]),
])
def test_documents(documents, operator, names):
    plain = documents.select("doc_id", "text")
    clashing = plain.withColumns({n: F.array(F.lit(n)) for n in names})
    # op9 numbers documents within the file of a partition: both have the same partitions
    assert sorted(map(str, operator(clashing).collect())) == sorted(map(str, operator(plain).collect()))


def test_vectors(spark):
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clashing = plain.withColumns({n: F.lit("x") for n in ("score", "rank", "query_id", "cell", "left", "right", "norm")})
    assert sorted(map(str, op1_ann_blocks(clashing).collect())) == sorted(map(str, op1_ann_blocks(plain).collect()))
