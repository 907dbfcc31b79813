"""python -m depweft.llm.fit: fits the models of personal data anew and stores them beside this file, with figures on held-back texts.

Everything comes from pii_samples with a fixed seed, so the same code gives the same models. It takes about a minute; run it after a
change to the samples, the lexicons or the features (a test tells when the stored models are no longer those of the code)."""

from __future__ import annotations

import json
from concurrent.futures import ProcessPoolExecutor

from depweft.llm.boosting import Boosted
from depweft.llm.pii import MODELS, SampleVocabulary, find, fitted
from depweft.llm.pii_samples import samples
from depweft.llm.pii_spans import KINDS


def figures(models: dict[str, Boosted], n: int = 2000, seed: int = 77) -> dict[str, tuple[float, float]]:
    """Precision and recall per kind on texts with other names, numbers and topics."""
    texts, topics = samples(n, seed)
    found = find([t for t, _ in texts], models, SampleVocabulary(topics))
    out = {}
    for kind in KINDS:
        true = {(i, s) for i, (_, spans) in enumerate(texts) for s in spans if s[0] == kind}
        got = {(i, s[:3]) for i, f in enumerate(found) for s in f if s[0] == kind}
        out[kind] = (round(len(true & got) / max(1, len(got)), 3), round(len(true & got) / max(1, len(true)), 3))
    return out


def main() -> None:
    with ProcessPoolExecutor(len(KINDS)) as pool:
        models = dict(zip(KINDS, pool.map(fitted, KINDS)))
    MODELS.write_text(json.dumps({k: m.to_dict() for k, m in models.items()}, separators=(",", ":")) + "\n")
    print(figures(models))


if __name__ == "__main__":
    main()
