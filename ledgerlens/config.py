"""Constants of the engine; every operator takes them as arguments with these defaults."""

RETRIEVE_DEPTH = 20
SUBMISSION_K = 5
FIRST_YEAR, LAST_YEAR = 2010, 2026
BM25_K1, BM25_B = 1.5, 0.75
RULE_MIN, RULE_MARGIN, RULE_TRUST = 62.0, 8.0, 78.0
ANSWER_TOLERANCE, AGREE_RELATIVE = 0.011, 1e-4
MAX_NODES, MAX_DEPTH = 128, 14
#: Names and factors of the unit scales.
UNIT_SCALES = {"dong": 1.0, "nghin": 1e3, "trieu": 1e6, "ty": 1e9, "tram_ty": 1e11, "nghin_ty": 1e12}
