"""Brute-force versions that several test modules compare with."""

import re

SPACE = r"[\x20\x09-\x0D]+"


def line_tokens(line):
    """Runs of five words in lower case; all words of a line of one to four."""
    w = [x for x in re.split(SPACE, line.lower()) if x]
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_lines(rows):
    """Removed (doc_id, line_no) of (doc_id, text) rows."""
    places = {(i, k): line_tokens(line) for i, t in rows if i is not None for k, line in enumerate((t or "").split("\n"))}
    kept = [(p, s) for p, s in sorted(places.items()) if s]
    return {p for n, (p, s) in enumerate(kept) if any(len(s & u) * 1.8 >= 0.8 * (len(s) + len(u)) - 1e-9 for _, u in kept[:n])}
