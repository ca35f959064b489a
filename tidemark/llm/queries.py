"""The subpackage's queries and their SQL."""

from __future__ import annotations

from tidemark.llm.decontaminate import OP1_SQL, op1_decontaminate
from tidemark.llm.langid import op6_langid
from tidemark.llm.lines import OP8_SQL, op8_lines
from tidemark.llm.media import op4_media
from tidemark.llm.mixing import OP10_SQL, op10_mix
from tidemark.llm.neardup import OP3_SQL, op3_neardup
from tidemark.llm.passages import OP9_SQL, op9_passages
from tidemark.llm.sharding import OP2_SQL, op2_shard
from tidemark.llm.toxicity import op7_toxicity
from tidemark.llm.urls import OP5_SQL, op5_urls

QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_shard": op2_shard, "op3_neardup": op3_neardup, "op4_media": op4_media, "op5_urls": op5_urls, "op6_langid": op6_langid, "op7_toxicity": op7_toxicity, "op8_lines": op8_lines, "op9_passages": op9_passages, "op10_mix": op10_mix}
ORACLES = {"op1_decontaminate": OP1_SQL, "op2_shard": OP2_SQL, "op3_neardup": OP3_SQL, "op5_urls": OP5_SQL, "op8_lines": OP8_SQL, "op9_passages": OP9_SQL, "op10_mix": OP10_SQL}
