"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, ranked, urls
from .crosstoken import op11_crosstoken
from .cws import op7_fingerprints
from .decontaminate import op5_decontaminate
from .licences import op4_licences
from .lm import op10_lm
from .mixing import op2_mixing
from .privacy import op3_privacy
from .ranked import op13_ranked
from .repeats import op8_repeats
from .simhash import op6_simhash
from .tokenfile import op9_tokenfile
from .toxicity import op1_toxicity
from .urls import op12_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_toxicity, op2_mixing, op3_privacy, op4_licences, op5_decontaminate, op6_simhash, op7_fingerprints, op8_repeats, op9_tokenfile, op10_lm, op11_crosstoken, op12_urls, op13_ranked)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op12_urls": urls.SQL, "op13_ranked": ranked.SQL}
