"""Chat examples by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, its text alone is trainable. Turns
after the last assistant turn, or a conversation without one, become one more example with nothing trainable, so that
the output holds every turn.

The output grows with the square of a conversation's turns, which the method implies. A row holds a whole conversation
in any case, so gathering one conversation in one row costs no more than its longest example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import prepare_workers

#: The template. Other roles than these three are written [ROLE name] text [/ROLE].
SYSTEM = ("[SYS] ", " [/SYS]")
USER = ("[INST] ", " [/INST]")
ASSISTANT = (" ", "</s>")
CONTROL = r"\\|</?s>|\[/?(?:INST|SYS|ROLE)"

_BODY = r"((?:[^\\<\[]++|\\.|<(?!/?s>)|\[(?!/?(?:INST|SYS|ROLE)))*+)"
_TURN = re.compile(
    rf"\[INST\] {_BODY}(?<= )\[/INST\]|\[SYS\] {_BODY}(?<= )\[/SYS\]|\[ROLE ((?:[^\\\]]|\\.)*+)\] {_BODY}(?<= )\[/ROLE\]| {_BODY}</s>",
    re.DOTALL,
)
#: The bodies above take the space before a closing string with them.
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    """A backslash before every control string and every backslash."""
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _rendered(turn: Column) -> Column:
    body = escaped(turn["text"])
    name = F.regexp_replace(turn["role"], r"([\\\[\]<])", r"\\$1")
    return (
        F.when(turn["role"] == "user", F.concat(F.lit(USER[0]), body, F.lit(USER[1])))
        .when(turn["role"] == "system", F.concat(F.lit(SYSTEM[0]), body, F.lit(SYSTEM[1])))
        .when(turn["role"] == "assistant", F.concat(F.lit(ASSISTANT[0]), body, F.lit(ASSISTANT[1])))
        .otherwise(F.concat(F.lit("[ROLE "), name, F.lit("] "), body, F.lit(" [/ROLE]")))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end: code points of the trainable span, end excluded.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Rows are ordered by turn, then role,
    then text; null turns come first. Null roles and texts count as empty. Rows with a null conv_id are one
    conversation. Repeated rows are turns of their own. An empty table gives no examples. The example without a
    trainable span has loss_start = loss_end = the length of ``formatted``.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**63))).alias("turn"), text("role").alias("role"), text("text").alias("text"))))
    whole = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    parts = whole.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", _rendered).alias("parts"))
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("roles", i) == "assistant") | (i == n))
    each = parts.select("conv_id", "roles", "parts", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("parts", F.col("end"))
    is_target = F.element_at("roles", F.col("end")) == "assistant"
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("end")), "")
    each = each.select("conv_id", "example", formatted.alias("formatted"), F.char_length(last).alias("last"), is_target.alias("target"))
    size = F.char_length("formatted")
    return each.select(
        "conv_id",
        F.col("example").cast("bigint").alias("example"),
        "formatted",
        F.when(F.col("target"), size - F.col("last") + len(ASSISTANT[0])).otherwise(size).cast("bigint").alias("loss_start"),
        F.when(F.col("target"), size - len(ASSISTANT[1])).otherwise(size).cast("bigint").alias("loss_end"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        user, system, role, other, assistant = m.groups()
        if user is not None:
            turns.append(("user", unescape(user[:-1])))
        elif system is not None:
            turns.append(("system", unescape(system[:-1])))
        elif role is not None:
            turns.append((unescape(role), unescape(other[:-1])))
        else:
            turns.append(("assistant", unescape(assistant)))
        at = m.end()
    return turns


READ = "conv_id bigint, example bigint, n_turns bigint, turns_sha256 string, loss string, chars bigint"


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples say: turns and their digest, and the text under the loss mask, unescaped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for conv, example, text, a, b in zip(f["conv_id"], f["example"], f["formatted"], f["loss_start"], f["loss_end"], strict=True):
                turns = parse(text)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, example, len(turns), digest, unescape(text[a:b]), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"])
            yield out.astype({"conv_id": "Int64"})

    prepare_workers(examples.sparkSession)
    return examples.mapInPandas(run, READ)


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    last = F.max(F.struct("example", "n_turns", "turns_sha256"))
    return (
        read_back(examples)
        .groupBy("conv_id")
        .agg(last.alias("last"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            F.col("last.n_turns").alias("n_turns"),
            F.col("last.turns_sha256").alias("turns_sha256"),
            F.char_length("loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
