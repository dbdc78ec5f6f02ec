"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from fractile.llm import ann, exact, html, licenses, mixing, neardup, packing, pii, secrets, toxicity


def queries() -> dict:
    return {
        "op1_packing": packing.query,
        "op2_minhash": neardup.query,
        "op3_mixing": mixing.query,
        "op4_secrets": secrets.query,
        "op5_pii": pii.query,
        "op6_ann": ann.query,
        "op7_html": html.query,
        "op8_licenses": licenses.query,
        "op9_exact_dedup": exact.query,
        "op10_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": neardup.SQL, "op3_mixing": mixing.SQL, "op8_licenses": licenses.SQL, "op9_exact_dedup": exact.SQL}
