"""Driver queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from cinderline.llm import collocations, secrets, spelling
from cinderline.llm.collocations import op13_collocations
from cinderline.llm.fingerprints import op7_fingerprints
from cinderline.llm.language import op2_language
from cinderline.llm.media import op5_media
from cinderline.llm.packing import op4_packing
from cinderline.llm.piece_codec import op9_pieces
from cinderline.llm.pseudonyms import op8_pseudonyms
from cinderline.llm.quality import op12_quality
from cinderline.llm.secrets import op10_secrets
from cinderline.llm.simhash import op1_simhash
from cinderline.llm.spelling import op11_spelling
from cinderline.llm.token_counts import op6_token_counts
from cinderline.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_media": op5_media,
    "op6_token_counts": op6_token_counts,
    "op7_fingerprints": op7_fingerprints,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_pieces": op9_pieces,
    "op10_secrets": op10_secrets,
    "op11_spelling": op11_spelling,
    "op12_quality": op12_quality,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op10_secrets": secrets.ORACLE_SQL, "op11_spelling": spelling.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
