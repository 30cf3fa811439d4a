"""Complete sentences from fragments of text, for batches and streams.

One pattern matches a sentence's end with the quotes and brackets after it. Batches use it in Spark's
own functions; the stateful stream uses the same pattern on what has come so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The least length of a sentence of its own, and abbreviations whose full stop ends no sentence.
SHORT = 24
ABBREVIATIONS = [
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st",
    "e.g", "i.e", "etc", "vs", "fig", "eq", "approx", "no",
    "al", "ph.d", "b.sc", "m.sc", "inc", "ltd", "co",
]

_WORD = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
#: A stop counts before white space or at the end, unless an abbreviation or a single letter stands before it.
END = rf"""(?:[!?]|(?<!(?:^|[\s(])(?:{_WORD}|\p{{L}})\.{{0,9}})\.(?=\s|\z))["')\]]*"""
_ENDS = regex.compile(END.replace(r"\z", r"\Z"), regex.IGNORECASE)
#: No character of any text, by Unicode's rules.
_CUT = "￿"


def array_of(text: Column) -> Column:
    """The sentences of whole texts: short ones join the one before, what follows the last end is a sentence too."""
    def bare(s: Column) -> Column:
        return F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")

    parts = F.split(F.regexp_replace(text, f"(?iU){END}", f"$0{_CUT}"), _CUT)
    done = F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), bare), lambda s: s != "")
    joined = F.array_join(F.transform(done, lambda s, i: F.when((i == 0) | (F.length(s) >= SHORT), F.concat(F.lit(_CUT), s)).otherwise(F.concat(F.lit(" "), s))), "")
    rest = bare(F.element_at(parts, -1))
    return F.filter(F.concat(F.split(joined, _CUT), F.array(rest)), lambda s: s != "")


def of_texts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, sentence) of whole texts; null and blank ones have none."""
    return rows.select(F.col(key), F.posexplode(array_of(F.col(text).cast("string"))).alias("n", "sentence"))


def complete(text: str) -> tuple[list[str], str]:
    """(sentences, rest) of what has come of a text so far."""
    out: list[str] = []
    last = 0
    for end in _ENDS.finditer(text):
        piece = text[last : end.end()].strip()
        last = end.end()
        if piece and out and len(piece) < SHORT:
            out[-1] = f"{out[-1]} {piece}"
        elif piece:
            out.append(piece)
    return out, text[last:]


def of_stream(fragments: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """(stream, sentence) as sentences complete, from a stream of (stream, seq, fragment).

    A stream that sends nothing for ``idle`` has ended: its rest is its last sentence, and its state goes.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        if state.hasTimedOut:
            state.remove()
            done = [held.strip()] if held.strip() else []
        else:
            rows = pd.concat(list(frames)).sort_values("seq")
            done, rest = complete(held + "".join(x or "" for x in rows["fragment"]))
            state.update((rest,))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({"stream": [key[0]] * len(done), "sentence": done})

    return fragments.groupBy("stream").applyInPandasWithState(step, "stream long, sentence string", "rest string", "append", GroupStateTimeout.ProcessingTimeTimeout)
