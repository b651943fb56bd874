"""Driver queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from . import chat_format, decontamination, exact_dedup, packing, periodic_runs, pii, quality, secret_scan, simhash_dedup, spelling, substring_dedup, suffix_dedup, token_files

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_quality": quality.op2_quality,
    "op3_simhash_dedup": simhash_dedup.op3_simhash_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_pii": pii.op7_pii,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_packing": packing.op9_packing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_token_files": token_files.op11_token_files,
    "op12_spelling": spelling.op12_spelling,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL = {
    "op1_secret_scan": secret_scan.OP1_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
