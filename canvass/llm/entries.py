"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canvass.llm.ball_tree import OP11_SQL, op11_ball_tree
from canvass.llm.line_dedup import OP13_SQL, op13_line_dedup
from canvass.llm.mixing import op8_mix
from canvass.llm.ngram_join import op4_ngram_jaccard
from canvass.llm.nn_descent import op5_nn_descent
from canvass.llm.quality_gbt import op2_quality_gbt
from canvass.llm.sentencepiece_nbest import op1_sentencepiece
from canvass.llm.suffix_dedup import op9_suffix_dedup
from canvass.llm.token_store import op10_token_store
from canvass.llm.toxicity_mil import op3_toxicity_mil
from canvass.llm.va_file import OP7_SQL, op7_va_topk
from canvass.llm.warc import OP6_SQL, op6_warc
from canvass.llm.whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_quality_gbt": op2_quality_gbt,
        "op3_toxicity_mil": op3_toxicity_mil,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_nn_descent": op5_nn_descent,
        "op6_warc": op6_warc,
        "op7_va_topk": op7_va_topk,
        "op8_mix": op8_mix,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_token_store": op10_token_store,
        "op11_ball_tree": op11_ball_tree,
        "op12_whitening": op12_whitening,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op7_va_topk": OP7_SQL, "op11_ball_tree": OP11_SQL, "op13_line_dedup": OP13_SQL}
