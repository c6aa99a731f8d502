"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, embeddings, lines, secrets, suffix
from .decontaminate import op8
from .embeddings import op3
from .lines import op6
from .mixing import op1
from .paragraphs import op5
from .pii import op2
from .secrets import op4
from .simhash import op10
from .suffix import op7
from .toxicity import op9

QUERIES = {
    "op1_mixing": op1,
    "op2_pii": op2,
    "op3_embedding_dedup": op3,
    "op4_secrets": op4,
    "op5_paragraph_minhash": op5,
    "op6_line_dedup": op6,
    "op7_suffix_dedup": op7,
    "op8_decontaminate": op8,
    "op9_toxicity": op9,
    "op10_simhash": op10,
}

ORACLES: dict[str, str] = {
    "op3_embedding_dedup": embeddings.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op7_suffix_dedup": suffix.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
}
