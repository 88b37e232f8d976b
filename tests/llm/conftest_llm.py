"""Helpers of the tests here."""


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def kept_lines(texts):
    """Brute force: every two lines in a row, and every line of 50 words, against all earlier ones."""
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n")
        windows = [tuple(lines[i : i + 2]) for i in range(len(lines) - 1)]
        gone, run = set(), set()
        for i, window in enumerate([*windows, None]):
            if window is not None and window in seen:
                run |= {i, i + 1}
            else:
                gone |= run if sum(len(lines[j].split()) for j in run) >= 10 else set()
                run = set()
            seen.add(window)
        for i, line in enumerate(lines):
            if len(line.split()) >= 50:
                gone |= {i} if line in seen else set()
                seen.add(line)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out
