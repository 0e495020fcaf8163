"""SARI of many outputs at once: n-grams are numbers, counts are sorted arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens (with those of its item) of the outputs that are scored in one step; a row is never cut.
STEP_TOKENS = 300_000


def _flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens of an array of lists of texts, the row and the text of each token."""
    rows, inner = np.asarray(pc.list_parent_indices(texts)), texts.flatten()
    text = np.asarray(pc.list_parent_indices(inner))
    return inner.flatten(), rows[text], text


def _counts(owner: np.ndarray, gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (owner * width + gram) and how often each occurs."""
    return np.unique(owner * width + gram, return_counts=True)


def _looked_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The counts of the wanted keys, 0 for those that do not occur."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 1.0)


def _f1(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.where(p + q > 0, 2 * p * q / np.where(p + q > 0, p + q, 1), 0.0)


def scores(outputs: pa.Array, sources: pa.Array, references: pa.Array, item: np.ndarray, order: int) -> np.ndarray:
    """SARI (0 to 100) of each row of outputs. All are lists of texts, texts lists of tokens; item is the row of its item in sources and references."""
    n, items, many = len(outputs), len(sources), np.asarray(pc.list_value_length(references)).astype(np.int64)
    tokens, owners, texts, base = [], [], [], 0
    for x in (outputs, sources, references):
        t, row, text = _flat(x)
        tokens.append(t)
        owners.append(row.astype(np.int64))
        texts.append(text.astype(np.int64) + base)
        base += int(text[-1]) + 1 if len(text) else 0
    sizes = [len(t) for t in tokens]
    word = np.asarray(pa.concat_arrays(tokens).dictionary_encode().indices).astype(np.int64)
    owner, text, kind = np.concatenate(owners), np.concatenate(texts), np.repeat([0, 1, 2], sizes)
    words, gram, start, total = int(word.max()) + 1 if len(word) else 1, word, np.arange(len(word)), np.zeros(n)
    for k in range(order):
        if k:  # a run of k + 1 tokens is a run of k and the token that follows in the same text
            stays = start + k < len(word)
            stays[stays] = text[start[stays] + k] == text[start[stays]]
            start, gram = start[stays], gram[stays] * words + word[start[stays] + k]
            gram = np.unique(gram, return_inverse=True)[1].reshape(-1)
        width = int(gram.max()) + 1 if len(gram) else 1
        (ckey, c), (skey, s), (rkey, r) = (_counts(owner[start[own]], gram[own], width) for own in (kind[start] == x for x in range(3)))
        # an output's own n-grams
        row, its = ckey // width, item[ckey // width] * width + ckey % width
        c, cs, cr = c * many[item[row]], _looked_up(skey, s, its) * many[item[row]], _looked_up(rkey, r, its)
        kept, new = np.minimum(cs, c), cs == 0
        good = np.minimum(kept, cr)
        add = lambda x, at, size=n: np.bincount(at, x, size)
        k1, k2, k3 = add(good / np.maximum(kept, 1), row), add(kept > 0, row), add(good, row)
        a1, a2 = add(new & (cr > 0), row), add(new, row)
        # what an item's source and references hold
        of = skey // width
        s, sr = s * many[of], _looked_up(rkey, r, skey)
        k4 = add(np.minimum(s, sr), of, items)[item]
        a3 = add(_looked_up(skey, s, rkey) == 0, rkey // width, items)[item]
        # the source's n-grams that an output lacks: those of its item, once for each output
        first = np.searchsorted(of, np.arange(items))
        length = np.bincount(of, minlength=items)[item]
        to = np.repeat(np.arange(n), length)
        at = np.repeat(first[item] - np.cumsum(length) + length, length) + np.arange(len(to))
        gone = s[at] - _looked_up(ckey, c, to * width + skey[at] % width)
        d1, d2 = add(np.maximum(gone - sr[at], 0) / np.maximum(gone, 1) * (gone > 0), to), add(gone > 0, to)
        total += (_f1(_share(k1, k2), _share(k3, k4)) + _share(d1, d2) + _f1(_share(a1, a2), _share(a1, a3))) / 3
    return 100 * (total / order)


def steps(weights: np.ndarray, most: int = STEP_TOKENS) -> list[tuple[int, int]]:
    """Runs of rows (from, to) whose weights add up to at most `most`, one row at least."""
    out, begin, held = [], 0, 0
    for i, w in enumerate(weights.tolist()):
        if i > begin and held + w > most:
            out.append((begin, i))
            begin, held = i, 0
        held += w
    return out + [(begin, len(weights))] if len(weights) else out
