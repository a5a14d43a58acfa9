"""Plain versions that several tests share."""

from __future__ import annotations


def removed_words(docs, window):
    """(id, words, removed words, kept bytes) of each document, in the order given."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, (docs[i][1] or "").encode(), i))
    seen, out = set(), {}
    for i in order:
        words = (docs[i][1] or "").encode().split()
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            key = tuple(words[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[i] = (docs[i][0], len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return [out[i] for i in range(len(docs))]
