"""The protocol of extractors: whatever reads texts and answers in JSON, a model or a rule, in batches inside tasks."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from promptlake.functions.guarded import MESSAGE, Late, left

#: Seconds for a batch of texts, and texts in one.
SECONDS, ROWS = 60.0, 64


class Extractor(Protocol):
    """Answers texts one after another. It is pickled and sent to the tasks."""

    name: str

    def unavailable(self) -> str | None:
        """Why it can't work now, or None."""

    def answers(self, texts: list[str], deadline: float) -> Iterable[str | None]:
        """One answer a text, in order; may raise at a text, and should stop at the deadline (of time.monotonic)."""


def answered(extractor: Extractor, texts: list[str], seconds: float) -> list[tuple[str | None, str | None]]:
    """(answer, error) of every text, just one of them null.

    What raises costs its own text alone: the next texts are asked for anew. A text
    reached after the deadline, or answered after it, is late. No answer is an error.
    """
    deadline = time.monotonic() + seconds
    out: list[tuple[str | None, str | None]] = []
    while len(out) < len(texts):
        try:
            left(deadline)
            for answer in extractor.answers(texts[len(out) :], deadline):
                if len(out) == len(texts):
                    break
                left(deadline)
                out.append((answer, None) if answer is not None else (None, "no answer"))
            else:
                if len(out) < len(texts):
                    out.append((None, "no answer"))
        except Late:
            out += [(None, "deadline")] * (len(texts) - len(out))
        except Exception as e:  # the extractor's fault at this text
            out.append((None, f"{type(e).__name__}: {e}"[:MESSAGE]))
    return out


def extracted(df: DataFrame, extractor: Extractor, text: str = "text", seconds: float = SECONDS, rows: int = ROWS) -> DataFrame:
    """df with answer and error: every input row comes out, with just one of the two."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.slice(start, rows)
                told = answered(extractor, [t or "" for t in part.column(at).to_pylist()], seconds)
                new = [pa.array([t[i] for t in told], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "answer", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, answer string, error string")


class WordRules:
    """A deterministic extractor: proposes a rule for each of its words that a text holds, quoting from there to the line's end.

    words: word to (category, action). `broken` texts raise, as a model that fails would.
    """

    name = "word-rules"

    def __init__(self, words: dict[str, tuple[str, str]], broken: str | None = None):
        self.words, self.broken = words, broken

    def unavailable(self) -> str | None:
        return None if self.words else "no words"

    def answers(self, texts: list[str], deadline: float) -> Iterator[str]:
        for text in texts:
            left(deadline)
            if self.broken and re.search(self.broken, text):
                raise ValueError("can't read this text")
            found = [w for w in self.words if w in text]
            rules = [
                {"label": f"about {w}", "category": self.words[w][0], "detectorType": "SEMANTIC", "action": self.words[w][1], "priority": 100, "keywordsHint": [w, *others], "confidence": 0.9}
                for w in found
                for others in [sorted(set(found) - {w})[:1]]
            ]
            quote = text[text.index(found[0]) :].split("\n")[0][:200] if found else ""
            yield json.dumps({"sourceQuote": quote, "rules": rules}, ensure_ascii=False)


class WordConcepts(WordRules):
    """The same for concepts: words: word to (sensitivity, action)."""

    name = "word-concepts"

    def answers(self, texts: list[str], deadline: float) -> Iterator[str]:
        for text in texts:
            left(deadline)
            if self.broken and re.search(self.broken, text):
                raise ValueError("can't read this text")
            yield json.dumps(
                [
                    {"conceptKey": w, "name": w, "sensitivity": s, "action": a, "sourceQuote": text[text.index(w) :].split("\n")[0][:200], "confidence": 0.9}
                    for w, (s, a) in self.words.items()
                    if w in text
                ],
                ensure_ascii=False,
            )


__all__ = ["Extractor", "WordConcepts", "WordRules", "answered", "extracted"]
