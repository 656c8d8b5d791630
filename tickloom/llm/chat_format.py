"""Chat formatting: the nested field paths of a record choose the mapping that turns it into canonical turns.

DataFrame functions only. Records come in the union schema that a JSON reader infers over mixed files: a field that a
record does not have is null. The paths that are present are hashed, and the hash selects one of the declared layouts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

BEGIN, BETWEEN, END = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class One:
    """One turn of a fixed role; the fields that are present are joined by an empty line, without any there is no turn."""
    role: str
    fields: tuple[str, ...]

    def paths(self) -> tuple[str, ...]:
        return self.fields


@dataclass(frozen=True)
class Many:
    """A turn per element of the list at ``items``; ``names`` maps a layout's role names, others stay."""
    items: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        return f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"


@dataclass(frozen=True)
class Layout:
    """A record has this layout if it has any of ``marks`` (all paths if none are named) and no path of another layout."""
    name: str
    parts: tuple[One | Many, ...]
    marks: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return sorted({p for part in self.parts for p in part.paths()})

    def path_sets(self) -> list[tuple[str, ...]]:
        """Every set of paths that a record of this layout can show, as each field may be null."""
        every = self.paths()
        marks = set(self.marks or every)
        return [s for n in range(1, len(every) + 1) for s in combinations(every, n) if marks & set(s)]


LAYOUTS = (
    Layout("prompt", (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("completion",))), ("prompt", "completion")),
    Layout("instruction", (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))), ("instruction", "input", "output")),
    Layout("messages", (Many("messages", "role", "content"),)),
    Layout("shared", (Many("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),)),
    Layout("dialog", (Many("dialog.turns", "speaker", "utterance"),)),
)


def fingerprint(paths: Sequence[str]) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def registry(layouts: Sequence[Layout]) -> dict[str, str]:
    """Layout names by fingerprint; layouts that a record could not be told apart by are refused."""
    found: dict[str, str] = {}
    for layout in layouts:
        for paths in layout.path_sets():
            if found.setdefault(fingerprint(paths), layout.name) != layout.name:
                raise ValueError(f"layouts {found[fingerprint(paths)]} and {layout.name} share the paths {paths}")
    return found


def _at(schema: StructType, path: str) -> tuple[Column, DataType] | None:
    """The column of a dotted path and its type; None if the schema does not have it."""
    names = path.split(".")
    column, kind = None, schema
    for name in names:
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        column = F.col(f"`{name}`") if column is None else column.getField(name)
        kind = kind[name].dataType
    return column, kind


def _list(schema: StructType, path: str) -> tuple[Column, StructType] | None:
    found = _at(schema, path)
    if found is None or not isinstance(found[1], ArrayType) or not isinstance(found[1].elementType, StructType):
        return None
    return found[0], found[1].elementType


def _present(schema: StructType, path: str) -> Column | None:
    """Whether a record has a value at ``path``; for a list, whether any element has."""
    if "[]." not in path:
        found = _at(schema, path)
        return None if found is None else found[0].isNotNull()
    items, field = path.split("[].")
    found = _list(schema, items)
    if found is None or field not in found[1].names:
        return None
    return F.coalesce(F.exists(found[0], lambda x: x.getField(field).isNotNull()), F.lit(False))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _turns(schema: StructType, part: One | Many) -> Column:
    none = F.array().cast(TURNS)
    if isinstance(part, One):
        fields = [found[0].cast("string") for path in part.fields if (found := _at(schema, path)) is not None]
        if not fields:
            return none
        turn = F.struct(F.lit(part.role).alias("role"), F.concat_ws("\n\n", *fields).alias("text"))
        return F.when(F.coalesce(*fields).isNotNull(), F.array(turn).cast(TURNS)).otherwise(none)
    found = _list(schema, part.items)
    if found is None:
        return none

    def turn(x: Column) -> Column:
        role = _text(x.getField(part.role)) if part.role in found[1].names else F.lit("")
        text = _text(x.getField(part.text)) if part.text in found[1].names else F.lit("")
        for own, canonical in part.names:
            role = F.when(role == own, F.lit(canonical)).otherwise(role)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(F.filter(found[0], lambda x: x.isNotNull()), turn).cast(TURNS)


def canonical_turns(records: DataFrame, key: str = "conv_id", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``key, fingerprint, layout, turns`` (array of role and text) for every row of ``records``.

    The fingerprint covers those paths that some layout names, so other columns do not matter, whatever their names; a
    path of another type than the layout wants counts as absent. A record whose paths belong to no layout, or to more
    than one, has a null layout and null turns. Null list elements are no turns; a null role or text of a list element
    is empty. Rows are independent, so repeated and null keys need no care.
    """
    chosen = registry(layouts)
    known = {path: _present(records.schema, path) for path in sorted({p for layout in layouts for p in layout.paths()})}
    seen = F.filter(F.array(*[F.when(is_there, F.lit(path)) for path, is_there in known.items() if is_there is not None]).cast("array<string>"), lambda p: p.isNotNull())
    by_hash = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        turns = F.when(F.col("__layout") == layout.name, F.concat(*[_turns(records.schema, part) for part in layout.parts])).otherwise(turns)
    marked = records.withColumn("__fingerprint", F.md5(F.array_join(seen, "\n").cast("binary"))).withColumn("__layout", by_hash[F.col("__fingerprint")])
    return marked.select(F.col(f"`{key}`"), F.col("__fingerprint").alias("fingerprint"), F.col("__layout").alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """A text in which neither mark can occur: every ``#`` and every ``</`` is broken by a backslash, backslashes are doubled."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("<\\/"), F.lit("</")), F.lit("\\#"), F.lit("#"))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def formatted_chats(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``turns`` plus ``formatted`` and the loss mask ``loss_runs``, one (skip, take, rest) of characters per turn.

    A turn reads ``### role: text</turn>`` and a line feed; roles are percent-encoded and texts escaped, so texts that
    hold marks come back as they were. The mask is a run-length code over ``formatted``: of every turn, ``skip``
    characters are not trained on, ``take`` are, ``rest`` are not; ``take`` covers the text of each ``trained`` turn.
    No turns give an empty string, null turns a null one.
    """
    parts = turns.withColumn("__parts", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(BEGIN), F.url_encode(t["role"]), F.lit(BETWEEN)).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == trained).alias("own"))))

    def run(p: Column) -> Column:
        before, size = F.length(p["head"]), F.length(p["text"])
        return F.struct(
            F.when(p["own"], before).otherwise(before + size + len(END)).alias("skip"),
            F.when(p["own"], size).otherwise(0).alias("take"),
            F.when(p["own"], F.lit(len(END))).otherwise(0).alias("rest"))

    return parts.select(
        *[F.col(f"`{c}`") for c in turns.columns],
        F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
        F.transform("__parts", run).alias("loss_runs"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` plus ``read_turns`` (role, text) and ``loss_text``, both taken from ``formatted`` and ``loss_runs`` alone."""
    pieces = F.split("formatted", END)
    split = chats.withColumn("__pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(p: Column) -> Column:
        body = F.instr(p, BETWEEN)
        return F.struct(
            F.url_decode(p.substr(F.lit(len(BEGIN) + 1), body - len(BEGIN) - 1)).alias("role"),
            unescaped(p.substr(body + len(BETWEEN), F.length(p))).alias("text"))

    under = F.zip_with("__pieces", "loss_runs", lambda p, r: unescaped(p.substr(r["skip"] + 1, r["take"])))
    return split.select(
        *[F.col(f"`{c}`") for c in chats.columns], F.transform("__pieces", turn).alias("read_turns"), F.array_join(under, "").alias("loss_text"))


def chat_records(conversations: DataFrame) -> DataFrame:
    """One record per conversation in one of the layouts, by a hash of its id and by what its roles allow.

    Rows go by turn (null first), then role, then text; null roles and texts are empty. A conversation is one record, so
    its turns come together in one row. Null ids make one conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                 _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    shaped = whole.withColumn("roles", F.transform("rows", lambda r: r["role"])).withColumn("draw", F.pmod(F.crc32(_text(F.col("conv_id")).cast("binary")), F.lit(5)))
    single = F.array_join("roles", ",").isin("user,assistant", "system,user,assistant") & (F.size("roles") <= 3)
    usual = F.forall("roles", lambda r: r.isin("system", "user", "assistant"))
    kind = (F.when(single & (F.col("draw") == 0), "prompt").when(single & (F.col("draw") == 1), "instruction")
            .when(usual & (F.col("draw") == 2), "shared").when(F.col("draw") == 3, "dialog").otherwise("messages"))
    told = shaped.withColumn("kind", kind)
    count = F.size("rows")
    system = F.when(count == 3, F.get("rows", F.lit(0))["text"])
    user, answer = F.get("rows", count - 2)["text"], F.get("rows", count - 1)["text"]
    cut = F.instr(user, "\n\n")

    def only(name: str, value: Column) -> Column:
        return F.when(F.col("kind") == name, value)

    def speaker(role: Column) -> Column:
        return F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)

    return told.select(
        "conv_id",
        F.when(F.col("kind").isin("prompt", "instruction"), system).alias("system"),
        only("prompt", user).alias("prompt"), only("prompt", answer).alias("completion"),
        only("instruction", F.when(cut > 0, user.substr(F.lit(1), cut - 1)).otherwise(user)).alias("instruction"),
        only("instruction", F.when(cut > 0, user.substr(cut + 2, F.length(user)))).alias("input"), only("instruction", answer).alias("output"),
        only("messages", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))).alias("messages"),
        only("shared", F.transform("rows", lambda r: F.struct(speaker(r["role"]).alias("from"), r["text"].alias("value")))).alias("conversations"),
        F.struct(only("dialog", F.transform("rows", lambda r: F.struct(r["role"].alias("speaker"), r["text"].alias("utterance")))).alias("turns")).alias("dialog"))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Formatted conversations and what reads back from them, as digests, one row per conversation."""
    chats = read_back(formatted_chats(canonical_turns(chat_records(conversations))))
    spoken = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", "layout", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# The conversation that holds the template's own marks: both turns say the same.
MARKED = "\\### Assistant: </turn> ok"


def with_marked(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts hold marks of templates."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]).unionByName(extra)
