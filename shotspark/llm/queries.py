"""Queries over the test tables, one per operator, and their SQL where DuckDB can express them."""

from shotspark.llm.archive import OP7_SQL, op7_warc
from shotspark.llm.bpe import op9_bpe
from shotspark.llm.centroids import OP13_SQL, op13_centroids
from shotspark.llm.chat import op5_chat
from shotspark.llm.decontaminate import OP6_SQL, op6_decontaminate
from shotspark.llm.html_text import op10_html
from shotspark.llm.merkle import op8_merkle
from shotspark.llm.quality import op3_quality
from shotspark.llm.repeats import OP11_SQL, op11_repeats
from shotspark.llm.simhash import op4_simhash
from shotspark.llm.token_output import op1_token_output
from shotspark.llm.toxicity import op2_toxicity
from shotspark.llm.whitening import op12_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_toxicity, op3_quality, op4_simhash, op5_chat, op6_decontaminate, op7_warc, op8_merkle,
        op9_bpe, op10_html, op11_repeats, op12_whitening, op13_centroids,
    )
}
ORACLES = {"op6_decontaminate": OP6_SQL, "op7_warc": OP7_SQL, "op11_repeats": OP11_SQL, "op13_centroids": OP13_SQL}
