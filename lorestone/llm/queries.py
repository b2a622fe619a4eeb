"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .binary_ids import op7_dac_ids
from .language import op8_rank_order_profiles
from .lines import op10_line_dedup
from .minhash import op1_chosen_path
from .mixing import OP3_SQL, op3_mix_sources
from .neighbours import op6_anisotropic_search
from .packing import op2_pack_hilbert
from .privacy import op9_disclosure
from .quality import op5_compression_bands
from .resampling import OP11_SQL, op11_resample
from .substrings import op4_chunk_dedup
from .suffixes import op12_suffix_dedup
from .whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_chosen_path,
        op2_pack_hilbert,
        op3_mix_sources,
        op4_chunk_dedup,
        op5_compression_bands,
        op6_anisotropic_search,
        op7_dac_ids,
        op8_rank_order_profiles,
        op9_disclosure,
        op10_line_dedup,
        op11_resample,
        op12_suffix_dedup,
        op13_whitening,
    )
}
ORACLES = {"op3_mix_sources": OP3_SQL, "op11_resample": OP11_SQL}
