"""Cutting a long text into overlapping chunks at paragraphs and sentences."""

from __future__ import annotations

import re

# fixed values: shorter texts stay whole; a chunk's aim, its overlap, and the most chunks of a text
LEAST, TARGET, OVERLAP, MOST = 500, 400, 60, 20
SENTENCE = re.compile(r"(?<=[。！？.!?\n])")
ENDS = re.compile(r"[。！？.!?\n]")


def _packed(parts: list[str], joint: str) -> list[str]:
    """Neighbours put together while they stay within the aim."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(part) + len(joint) <= TARGET:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def chunks(text: str | None, most: int | None = MOST) -> list[str]:
    """Chunks of the text, at most so many (None: all of them); none if it is short."""
    text = text or ""
    paragraphs = [p for p in map(str.strip, re.split(r"\n{2,}", text)) if p]
    if len(text) < LEAST or (len(paragraphs) <= 1 and len(text) < 1.5 * LEAST):
        return []
    out: list[str] = []
    for block in _packed(paragraphs, "\n\n"):
        sentences = [block] if len(block) <= 1.5 * TARGET else [s for s in SENTENCE.split(block) if s.strip()]
        out += [c for c in map(str.strip, _packed(sentences, "")) if c]
    led = out[:1]
    for before, chunk in zip(out, out[1:], strict=False):
        tail = before[-OVERLAP:]
        end = ENDS.search(tail)
        tail = tail[end.end() :].strip() if end else tail
        led.append(f"...{tail}\n{chunk}" if len(tail) > 10 else chunk)
    return led[:most]
