"""Plain versions of the pipeline's stages, for small inputs."""

from __future__ import annotations

from test_decontaminate import brute as _hits
from test_jaccard import brute as _components
from test_lines import key


def brute_lines(docs):
    """[((id, text), kept text)] of rows whose ids are distinct and not null."""
    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    return [((i, t), "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or min(held[key(x)]) == i)) for i, t in docs]


def brute_jaccard(docs):
    """The ids that stay."""
    return {int(i) for i, _, c in _components(docs) if i == c}


def brute_decontaminate(text, items):
    """Positions of hit words."""
    return _hits(text, items)[1]
