"""Operators for training data. Nothing outside this package imports it."""

from tomeflow.llm import encoding, neighbours, packing, repeated_lines, residue, spam, splitting, tokens, truncation

QUERIES = {
    "p2_found": encoding.p2_found,
    "p2_restored": encoding.p2_restored,
    "p3_found": truncation.p3_found,
    "p3_rates": truncation.p3_rates,
    "p1_found": residue.p1_found,
    "p1_clean": residue.p1_clean,
    "p4_found": splitting.p4_found,
    "p4_pieces": splitting.p4_pieces,
    "p4_whole": splitting.p4_whole,
    "p5_found": neighbours.p5_found,
    "p5_top10": neighbours.p5_top10,
    "p6_found": repeated_lines.p6_found,
    "p6_clean": repeated_lines.p6_clean,
    "p7_ids": tokens.p7_ids,
    "p8_containers": packing.p8_containers,
    "p8_fill": packing.p8_fill,
    "p8_check": packing.p8_check,
    "p9_found": spam.p9_found,
}
ORACLE: dict[str, str] = {
    "p4_found": splitting.P4_FOUND_SQL,
    "p4_whole": splitting.P4_WHOLE_SQL,
    "p8_check": packing.P8_CHECK_SQL,
    "p5_found": neighbours.P5_FOUND_SQL,
    "p6_found": repeated_lines.P6_FOUND_SQL,
    "p6_clean": repeated_lines.P6_CLEAN_SQL,
}
