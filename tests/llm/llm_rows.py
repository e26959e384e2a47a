"""Rows with every difficulty that operators promise to handle."""

SCHEMA = "doc_id long, text string, source string, kept boolean, n_words string"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
EDGE_ROWS = [
    (1, "the same old text of some words here and there", "a", None, "x"),
    (2, "the same old text of some words here and there", "b", True, None),
    (2, "the same old text of some words here and there", "b", True, None),
    (3, None, None, None, None),
    (4, "", "a", False, "y"),
    (None, "one two three four five six seven eight nine ten eleven", "b", None, None),
    (5, LONG, "b", None, None),
    (6, "ok", "a", None, None),
    (7, "x" * 70_000, "c", None, None),
]
