"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import divergence, hilbert, htmltext, langid, licenses, maxent, mixing, packing, prefixtrie, quality, secrets, simhash, warc


def queries() -> dict:
    return {
        "op1_license_scan": licenses.query,
        "op2_warc_archives": warc.query,
        "op3_secret_scan": secrets.query,
        "op4_html_main_text": htmltext.query,
        "op5_language_id": langid.query,
        "op6_bestfit_packing": packing.query,
        "op7_quality_rules": quality.query,
        "op8_hilbert_neighbours": hilbert.query,
        "op9_simhash_neardup": simhash.query,
        "op10_source_mixing": mixing.query,
        "op11_lm_scoring": maxent.query,
        "op12_prefix_trie": prefixtrie.query,
        "op13_source_divergence": divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.SQL,
        "op2_warc_archives": warc.SQL,
        "op10_source_mixing": mixing.SQL,
        "op12_prefix_trie": prefixtrie.SQL,
        "op13_source_divergence": divergence.SQL,
    }
