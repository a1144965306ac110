"""Chat formatting: layouts are told apart by their field paths.

Everything runs as DataFrame expressions over JSON records.  A record's schema,
without its types, is hashed; the hash selects a declarative mapping, which
turns the record into canonical turns; the template renders turns reversibly
and tells which code points are the assistant's, the loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, spans

TURN = "struct<role: string, text: string>"
#: Control strings of the template, and what stands for them inside roles and texts (the escape sign first).
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Names of roles that layouts use for the canonical ones.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """One layout: its field paths, and either the list of messages or fields that are turns.

    messages: (path of the list, field of the role, field of the text); turns:
    (role, fields whose texts, joined by blank lines, are the turn) in order; a
    turn without any text is left out.
    """

    name: str
    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _listed(name: str, where: str, role: str, text: str, *more: str) -> Mapping:
    return Mapping(name, (*(f"{where}[].{x}" for x in (role, text)), *more), messages=(where, role, text))


MAPPINGS = (
    _listed("messages", "messages", "role", "content"),
    _listed("messages_with_id", "messages", "role", "content", "id"),
    _listed("shared_conversations", "conversations", "from", "value"),
    _listed("shared_conversations_with_id", "conversations", "from", "value", "id"),
    Mapping("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_instruction", ("input", "instruction", "output", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(schema: Column) -> Column:
    """The schema of a variant in DDL with all types but objects and arrays left out."""
    named = F.regexp_replace(schema, r"(: |<)(?:STRING|VOID|BIGINT|BOOLEAN|DOUBLE|FLOAT|TIMESTAMP(?:_NTZ)?|DATE|BINARY|DECIMAL\([0-9,]+\))", "$1_")
    return F.regexp_replace(named, "`", "")


def _ddl(paths: tuple[str, ...]) -> str:
    """What field_paths gives for a record with these paths; names are in order."""
    fields: dict[str, list[str] | None] = {}
    for p in paths:
        head, sep, tail = p.partition("[].")
        fields.setdefault(head, [] if sep else None)
        if sep:
            fields[head].append(tail)
    show = lambda k: f"{k}: ARRAY<OBJECT<{', '.join(f'{x}: _' for x in sorted(fields[k]))}>>" if fields[k] else f"{k}: _"
    return f"OBJECT<{', '.join(show(k) for k in sorted(fields))}>"


def fingerprint(record: Column) -> Column:
    """A hash of the nested field paths of a JSON record; null if it is no JSON."""
    return F.xxhash64(field_paths(F.schema_of_variant(F.try_parse_json(record))))


def _turns(m: Mapping, record: Column) -> Column:
    if m.messages:
        where, role, text = m.messages
        parsed = F.from_json(record, f"struct<`{where}`: array<struct<`{role}`: string, `{text}`: string>>>")[where]
        return F.transform(parsed, lambda x: F.struct(x[role].alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
    fields = sorted({f for _, group in m.turns for f in group})

    def build(r: Column) -> Column:
        turn = lambda role, group: F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[r[f] for f in group]), lambda t: F.length(t) > 0), "\n\n").alias("text"))
        return F.filter(F.array(*[turn(role, group) for role, group in m.turns]), lambda t: F.length(t["text"]) > 0)

    return spans.let(F.from_json(record, "struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">"), build)


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, rename: bool = True) -> DataFrame:
    """records with layout (the mapping's name) and turns (array<struct<role, text>>).

    A record whose paths no mapping has, a null one and one that is no JSON have
    null layout and turns.  A missing role is empty.  rename puts other names of roles as the canonical.
    """
    spark = records.sparkSession
    hashes = spark.createDataFrame([(m.name, _ddl(m.paths)) for m in mappings], "layout string, paths string").select("layout", F.xxhash64("paths").alias("h")).collect()
    layout = F.lit(None).cast("string")
    for r in hashes:
        layout = F.when(F.col("_fingerprint") == r["h"], r["layout"]).otherwise(layout)
    turns = F.lit(None).cast(f"array<{TURN}>")
    for m in mappings:
        turns = F.when(F.col("layout") == m.name, _turns(m, F.col(record))).otherwise(turns)
    role = lambda x: F.coalesce(x["role"], F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    known = (lambda x: F.coalesce(F.element_at(names, role(x)), role(x))) if rename else role
    found = records.drop("layout", "turns").withColumn("_fingerprint", fingerprint(F.col(record))).withColumn("layout", layout)
    return found.withColumn("turns", F.transform(turns, lambda x: F.struct(known(x).alias("role"), x["text"].alias("text")))).drop("_fingerprint")


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    """Every sign of escape in an escaped text begins a pair, so pairs can be put back one kind after another, the sign itself last."""
    for a, b in reversed(pairs):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def rendered(turns: Column) -> Column:
    """struct(formatted, mask): the text, and the spans (start, end in code points) of the assistant's texts in it."""

    def build(parts: Column) -> Column:
        size = F.transform(parts, lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE))
        placed = F.arrays_zip(parts.alias("p"), spans.sums_before(size).alias("at"))
        loss = F.filter(placed, lambda x: x["p"]["loss"])
        mask = F.transform(loss, lambda x: F.struct((x["at"] + F.length(x["p"]["head"])).alias("start"), (x["at"] + F.length(x["p"]["head"]) + F.length(x["p"]["body"])).alias("end")))
        text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
        return F.struct(text.alias("formatted"), mask.alias("mask"))

    part = lambda t: F.struct(F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit(MIDDLE)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))
    return spans.let(F.transform(turns, part), build)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, r"\Q" + CLOSE + r"\E"), lambda p: F.length(p) > 0)

    def turn(p: Column) -> Column:
        colon = F.instr(p, MIDDLE)
        role = F.substring(p, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(F.substring(p, colon + len(MIDDLE), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped and joined."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def format_records(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, rename: bool = True) -> DataFrame:
    """canonical(records) with formatted and mask (null where the layout is unknown; empty where there are no turns)."""
    c = canonical(records.drop("formatted", "mask"), record, mappings, rename)
    return c.withColumn("_r", rendered(F.col("turns"))).select("*", "_r.formatted", "_r.mask").drop("_r")


def records_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): the rows of each conversation, by turn (ties by role, then text), as a JSON record of messages."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    turns = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return conversations.groupBy(conv_id).agg(F.to_json(F.struct(turns.alias("messages"))).alias("record"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    odd = "\\### Assistant: </turn> ok"
    c = shared.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    done = format_records(records_of(c.unionByName(extra)), rename=False)
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("back"), masked(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
