"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from folivane.llm import answer_defects, canonical, leakage, mixing, near_duplicates, repeated_lines, scan_noise, shared_spans, splitting

QUERIES = {
    "p1_found": answer_defects.found,
    "p2_found": repeated_lines.found,
    "p2_clean": repeated_lines.clean,
    "p3_found": scan_noise.found,
    "p3_repaired": scan_noise.repaired,
    "p4_found": canonical.found,
    "p4_clean": canonical.clean,
    "p5_found": splitting.found,
    "p5_pieces": splitting.all_pieces,
    "p6_found": near_duplicates.found,
    "p6_groups": near_duplicates.groups,
    "p7_found": leakage.found,
    "p7_report": leakage.report,
    "p8_mix": mixing.mix,
    "p8_shares": mixing.mix_shares,
    "p9_found": shared_spans.found,
    "p9_shared": shared_spans.shared,
    "p9_stretches": shared_spans.found_places,
    "p9_clean": shared_spans.clean,
}

SQL = {
    "p2_found": repeated_lines.SQL_FOUND,
    "p2_clean": repeated_lines.SQL_CLEAN,
    "p4_found": canonical.SQL_FOUND,
    "p4_clean": canonical.SQL_CLEAN,
    "p5_found": splitting.SQL_FOUND,
    "p6_found": near_duplicates.SQL_FOUND,
    "p6_groups": near_duplicates.SQL_GROUPS,
    "p7_found": leakage.SQL_FOUND,
    "p7_report": leakage.SQL_REPORT,
    "p9_found": shared_spans.SQL_FOUND,
    "p9_shared": shared_spans.SQL_SHARED,
    "p9_stretches": shared_spans.SQL_STRETCHES,
}
