"""The training-data queries and their SQL oracles."""

from __future__ import annotations

from graphloom.llm.decontaminate import OP3_SQL, op3_decontaminate
from graphloom.llm.html import op5_html
from graphloom.llm.langid import op10_langid
from graphloom.llm.licenses import OP2_SQL, op2_licenses
from graphloom.llm.media import op7_media
from graphloom.llm.packing import op6_packing
from graphloom.llm.pii import op8_pii
from graphloom.llm.quality import op4_quality
from graphloom.llm.simhash import op9_simhash
from graphloom.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_licenses": op2_licenses,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_html": op5_html,
    "op6_packing": op6_packing,
    "op7_media": op7_media,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_langid": op10_langid,
}

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op2_licenses": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
}
