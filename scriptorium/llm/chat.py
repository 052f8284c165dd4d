"""Chat rendering with a grammar round trip.

A conversation renders as one line of turns. A user turn is `<s>[INST] text [/INST]`, an assistant turn
` text </s>`, and any other role is `<s>[ROLE] role [TEXT] text [/TEXT]`. The parser is deterministic:
at each turn the opening mark tells the kind, and the text runs to the next control string that no
backslash precedes. A text is rendered as it is; if the reparsed turn differs from its source (it holds
control strings, say), it is rendered again with a backslash before each backslash and each control
string, and the reparsed turn must then be identical. The loss mask is the span of each assistant text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/TEXT]")
ANY = re.compile("|".join(map(re.escape, CONTROL)))
RISKY = re.compile(r"\\|" + ANY.pattern)
#: What ends a text: an escape (skipped), or a control string.
STOP = re.compile(r"\\(?:\\|" + ANY.pattern + ")|" + ANY.pattern)
ESCAPED = re.compile(r"\\(\\|" + ANY.pattern + ")")


class GrammarError(ValueError):
    """Text that the template's grammar doesn't derive."""


def escape(text: str) -> str:
    return RISKY.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _frame(role: str, text: str, name: str) -> tuple[str, int]:
    """The rendered turn and where its text starts. name: the role as rendered."""
    if role == "user":
        return f"<s>[INST] {text} [/INST]", len("<s>[INST] ")
    if role == "assistant":
        return f" {text} </s>", 1
    return f"<s>[ROLE] {name} [TEXT] {text} [/TEXT]", len(f"<s>[ROLE] {name} [TEXT] ")


def _until(rendered: str, at: int, mark: str) -> tuple[int, int]:
    """Where the text from `at` ends, and where what follows ` mark` starts."""
    found = next((m for m in STOP.finditer(rendered, at) if m[0][0] != "\\"), None)
    if not found or found[0] != mark or found.start() <= at or rendered[found.start() - 1] != " ":
        raise GrammarError(f"{mark} expected")
    return found.start() - 1, found.end()


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """(role, text, the text's span as rendered, end) of the turn that starts at `at`."""
    if rendered.startswith("<s>[INST] ", at):
        start = at + len("<s>[INST] ")
        stop, end = _until(rendered, start, "[/INST]")
        return "user", unescape(rendered[start:stop]), (start, stop), end
    if rendered.startswith("<s>[ROLE] ", at):
        start = at + len("<s>[ROLE] ")
        stop, start_text = _until(rendered, start, "[TEXT]")
        role = unescape(rendered[start:stop])
        if not rendered.startswith(" ", start_text):
            raise GrammarError("text expected")
        start = start_text + 1
        stop, end = _until(rendered, start, "[/TEXT]")
        return role, unescape(rendered[start:stop]), (start, stop), end
    if rendered.startswith(" ", at):
        stop, end = _until(rendered, at + 1, "</s>")
        return "assistant", unescape(rendered[at + 1 : stop]), (at + 1, stop), end
    raise GrammarError("no turn")


def parse_turns(rendered: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    at = 0
    while at < len(rendered):
        role, text, span, at = parse_turn(rendered, at)
        yield role, text, span


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn rendered so that parsing it gives exactly (role, text), and its text's span."""
    for write in (str, escape):
        rendered, start = _frame(role, write(text), write(role))
        try:
            found = parse_turn(rendered)
        except GrammarError:
            continue
        if found[:2] == (role, text) and found[3] == len(rendered):
            return rendered, *found[2]
    raise GrammarError("no rendering")


def _render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        turns = [render_turn(r, t) for r, t in zip(rows["role"], rows["text"], strict=True)]
        rows["rendered"] = [t[0] for t in turns]
        loss = rows["role"].to_numpy() == "assistant"
        rows["mask_start"] = [t[1] if own else 0 for t, own in zip(turns, loss, strict=True)]
        rows["mask_end"] = [t[2] if own else 0 for t, own in zip(turns, loss, strict=True)]
        yield rows


def render_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered, mask_start, mask_end) of each row; a conversation's output is its
    rows' `rendered`, joined in the order of turn, role and text. The loss mask [mask_start, mask_end) is an assistant's text as
    rendered, and empty elsewhere.

    Null text and null role count as empty; any role string round-trips. A null turn comes first. Repeated rows
    are turns of their own. Other columns are left out.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInPandas(_render, "conv_id long, turn long, role string, text string, rendered string, mask_start int, mask_end int")


class _Reader:
    """What is read back from one conversation's output, given piece by piece: turns by the parser alone, loss text by the mask alone.

    The output is parsed as it stands joined: a turn is taken off once the next one follows it, so that its end is
    found by the grammar, not by where a row ends."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.output = ""

    def read(self, rendered: str, mask: tuple[int, int]) -> None:
        self.formatted_chars += len(rendered)
        marked = unescape(rendered[mask[0] : mask[1]])
        self.loss_chars += len(marked)
        self.loss.update(marked.encode())
        before = len(self.output)
        self.output += rendered
        at = 0
        while at < before:
            at = self._turn(at)
        self.output = self.output[at:]

    def _turn(self, at: int) -> int:
        role, text, _, end = parse_turn(self.output, at)
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        return end

    def row(self, conv_id) -> tuple:
        at = 0
        while at < len(self.output):
            at = self._turn(at)
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in READ.split(", ")]
    own, reader = None, None
    for rows in frames:
        done = []
        ids = [None if pd.isna(x) else int(x) for x in rows["conv_id"]]
        for conv_id, rendered, *mask in zip(ids, rows["rendered"], rows["mask_start"], rows["mask_end"], strict=True):
            if reader is None or conv_id != own:
                if reader is not None:
                    done.append(reader.row(own))
                own, reader = conv_id, _Reader()
            reader.read(rendered, mask)
        yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
    if reader is not None:
        yield pd.DataFrame([reader.row(own)], columns=names).astype({"conv_id": "Int64"})


def read_chats(rendered: DataFrame) -> DataFrame:
    """Each conversation's turns and loss text, parsed from its output: counts and digests.

    A conversation's digests need its turns in order. They stream through a sorted partition, a turn at a
    time in memory, so a conversation may be of any length. Rows with null conv_id are one conversation.
    """
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "rendered", "mask_start", "mask_end").mapInPandas(_read, READ)
