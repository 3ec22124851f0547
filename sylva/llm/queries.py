"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprints, langid, license_scan, mixing, packing, quality, simhash_dedup, telephony, url_filter, wrappers


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_simhash": simhash_dedup.op2_simhash,
        "op3_html": wrappers.op3_html,
        "op4_url": url_filter.op4_url,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_quality": quality.op6_quality,
        "op7_license": license_scan.op7_license,
        "op8_language": langid.op8_language,
        "op9_media": telephony.op9_media,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op7_license": license_scan.sql()}
