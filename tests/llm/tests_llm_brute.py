import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

"""Plain versions of the pipeline's filtering stages."""
from test_neardup import brute


def lines_left(rows, sites):
    """Rows (doc_id, text, lang, source, n_chars) after line dedup, by doc_id."""
    spread, first = {}, {}
    for i, t, _, s, _ in rows:
        for p, line in enumerate((t or "").split("\n")):
            k = line.strip(" ")
            if k:
                spread.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, t, lang, s, n in rows:
        if t is None:
            out.append((i, t, lang, s, n))
            continue
        lines = t.split("\n")
        kept = [x for p, x in enumerate(lines)
                if not (x.strip(" ") and len(spread[x.strip(" ")]) >= sites and first[x.strip(" ")] != (i, p))]
        text = "\n".join(kept)
        if len(kept) == len(lines):
            out.append((i, t, lang, s, n))
        elif text.strip(" "):
            out.append((i, text, lang, s, len(text)))
    return sorted(out)


def classes_of(rows):
    return brute(rows)
