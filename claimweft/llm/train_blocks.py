"""python -m claimweft.llm.train_blocks PAGES CLAIMS SAMPLES [ROWS [OUT]]: train the shipped weights of the block labeller.

Reads the url, markdown and text of parquet pages, the text of claims and sentences of known languages, labels pages weakly, trains on at most ROWS of
them (4,000 by default) in both forms, with markup and without, and reports the accuracy on as many held-out pages.
"""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from claimweft.llm.blocks import BlockLabeller, Reader, fit, handed_down
from claimweft.llm.lang import Detector, LanguageCode
from claimweft.llm.weak_labels import WeakLabeller


def main(pages: str, claims: str, samples: str, rows: str = "4000", out: str | None = None) -> None:
    rows, out = int(rows), out or str(Path(__file__).with_name("blocks.npz"))
    table = pq.read_table(pages, columns=["url", "markdown", "text"]).to_pylist()
    known = [t for t in pq.read_table(claims, columns=["text"]).column("text").to_pylist() if t]
    code = LanguageCode.fit([(r["lang"], r["text"]) for r in pq.read_table(samples).to_pylist()])
    weak = WeakLabeller([(r["url"], r["markdown"] or "") for r in table], known, [lang if sure >= 0.5 else None for lang, sure, _ in Detector(code).texts(known)])
    chosen = np.random.default_rng(11).permutation(len(table))[:2 * rows]
    labelled = []
    for i in chosen:
        r = table[i]
        markdown, text = r["markdown"] or "", r["text"] or ""
        labels = weak.label(r["url"], markdown)
        at = [k for k, x in enumerate(labels) if x >= 0]
        plain = [0] * (text.count("\n") + 1)
        for k, label in handed_down(markdown, at, np.array([labels[k] for k in at]), text):
            plain[k] = int(label or 0)
        labelled.append([(markdown, labels), (text, plain)])
    training = [x for n, both in enumerate(labelled[:rows]) for x in (both if n % 3 == 0 else both[:1])]
    weights = fit(training)
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in weights.items()})
    model, reader = BlockLabeller.load(out), Reader()
    for form in (0, 1):
        held = [both[form] for both in labelled[rows:]]
        right = wrong_on = wrong_off = 0
        for (text, labels), (at, p) in zip(held, model.pages(reader, [t for t, _ in held])):
            truth = np.array([labels[k] for k in at])
            guess = p > 0.5
            right += int((guess == truth).sum())
            wrong_on += int((guess & (truth == 0)).sum())
            wrong_off += int((~guess & (truth == 1)).sum())
        print(("markdown", "text")[form], "right", right, "article taken for furniture", wrong_on, "furniture missed", wrong_off)


if __name__ == "__main__":
    main(*sys.argv[1:])
