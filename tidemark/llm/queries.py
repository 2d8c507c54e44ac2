"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontaminate, exactdedup, html, langid, licences, mixing, pii, sharding, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_sharding": sharding.op2_sharding,
    "op3_licences": licences.op3_licences,
    "op4_langid": langid.op4_langid,
    "op5_chat": chat.op5_chat,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_exactdedup": exactdedup.op9_exactdedup,
    "op10_html": html.op10_html,
}

ORACLES: dict[str, str] = {
    "op3_licences": licences.op3_sql(),
    "op5_chat": chat.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_exactdedup": exactdedup.OP9_SQL,
}
