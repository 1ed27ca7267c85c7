"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record's schema fingerprint is the hash of the nested field paths that it fills. Each layout states
the paths it consists of and how they become turns; the fingerprint, not a guess, selects the layout,
and a record of no known layout keeps a null ``turns``. Canonical turns are rendered with a template
``### role: text</turn>``; ``\\``, ``###`` and ``</turn>`` inside texts (and ``:`` in roles) are escaped
so that the output reads back to exactly the same turns. The loss spans are the places of assistant
texts in the output. Everything is DataFrame expressions.

Defined cases: null roles and texts are empty; turns of equal number stand in the order of role, then
text; repeated rows are turns of their own; a conversation stands in one row because its output is one
string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

END = "</turn>\n"
HEAD = "### "
SEP = ": "
#: In this order, and undone in the opposite one: no escape makes a character that a later one escapes.
ESCAPES = [("\\", "\\b"), ("###", "\\h\\h\\h"), ("</turn>", "\\l/turn>")]
UNESCAPES = [("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")]


def escape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), UNESCAPES, text)


# ---------------------------------------------------------------- schema fingerprints


def field_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, the column whose presence fills it) of each leaf; ``[]`` marks elements of an array."""
    out: list[tuple[str, str]] = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        if isinstance(kind, T.StructType):
            out += field_paths(kind, f"{path}.")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += [(f"{path}[].{g.name}", path) for g in kind.elementType.fields]
        else:
            out.append((path, path))
    return out


def schema_fingerprint(schema: T.StructType, ignore: tuple[str, ...] = ()) -> Column:
    """Hash of the sorted paths that a row fills."""
    paths = [(p, c) for p, c in field_paths(schema) if p not in ignore]
    filled = F.array(*[F.when(F.col(c).isNotNull(), F.lit(p)) for p, c in sorted(paths)])
    return F.xxhash64(F.array_join(filled, "\n"))


@dataclass(frozen=True)
class Layout:
    """``needs`` and any subset of ``may`` are the paths of this layout; ``turns`` makes its canonical turns."""

    name: str
    needs: tuple[str, ...]
    turns: str
    may: tuple[str, ...] = ()

    def fingerprints(self) -> list[Column]:
        sets = [[*self.needs, *some] for n in range(len(self.may) + 1) for some in combinations(self.may, n)]
        return [F.xxhash64(F.lit("\n".join(sorted(s)))) for s in sets]


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


#: A layout of another corpus is one more entry here.
LAYOUTS = [
    Layout("messages", ("messages[].role", "messages[].content"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout(
        "from_value",
        ("conversations[].from", "conversations[].value"),
        "transform(conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))",
    ),
    Layout("prompt_response", ("prompt", "response"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    Layout("system_prompt_response", ("prompt", "response", "system"), f"array({_turn('system', '`system`')}, {_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    Layout("prompt_completion", ("completion", "prompt"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'completion')})"),
    Layout("instruction_output", ("instruction", "output"), f"array({_turn('user', 'instruction')}, {_turn('assistant', 'output')})"),
    Layout(
        "instruction_input_output", ("input", "instruction", "output"),
        f"array({_turn('user', 'concat(instruction, chr(10), chr(10), input)')}, {_turn('assistant', 'output')})",
    ),
]


def canonical_turns(records: DataFrame, id_col: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """id, layout (null: unknown), turns array<struct<role, text>>, of records in any of the layouts."""
    columns = set(records.columns)
    mark = schema_fingerprint(records.schema, (id_col,))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in reversed([x for x in layouts if {p.split("[")[0].split(".")[0] for p in x.needs} <= columns]):
        fits = reduce(lambda a, b: a | b, [F.col("__schema") == f for f in x.fingerprints()])
        layout, turns = F.when(fits, F.lit(x.name)).otherwise(layout), F.when(fits, F.expr(x.turns)).otherwise(turns)
    clean = "transform(turns, t -> named_struct('role', coalesce(t.role, ''), 'text', coalesce(t.text, '')))"
    return records.withColumn("__schema", mark).select(id_col, layout.alias("layout"), turns.alias("turns")).withColumn("turns", F.expr(clean))


# ---------------------------------------------------------------- template


def render(chats: DataFrame, id_col: str, loss_role: str = "assistant") -> DataFrame:
    """id, formatted, loss_spans array<struct<start, length>> (0-based code points) of canonical turns."""
    one = chats.select(id_col, F.posexplode("turns").alias("at", "t"))
    head = F.concat(F.lit(HEAD), F.replace(escape(F.col("t.role")), F.lit(":"), F.lit("\\c")), F.lit(SEP))
    one = one.select(id_col, "at", F.col("t.role").alias("role"), head.alias("head"), escape(F.col("t.text")).alias("body"))
    length = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head")
    one = one.withColumn("span", F.when(F.col("role") == loss_role, F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    part = F.struct("at", F.concat("head", "body", F.lit(END)).alias("s"), "span")
    return one.groupBy(id_col).agg(F.array_sort(F.collect_list(part)).alias("p")).select(
        id_col, F.expr("array_join(transform(p, x -> x.s), '')").alias("formatted"), F.expr("transform(filter(p, x -> x.span IS NOT NULL), x -> x.span)").alias("loss_spans")
    )


def read_back(formatted: Column) -> Column:
    """The canonical turns of a rendered conversation."""
    parts = F.split(formatted, END)
    turns = F.slice(parts, 1, F.size(parts) - 1)  # nothing stands after the last end mark

    def turn(s: Column) -> Column:
        role = F.substring_index(F.substring(s, len(HEAD) + 1, 2**31 - 1), SEP, 1)
        text = F.substring(s, F.length(role) + len(HEAD) + len(SEP) + 1, F.lit(2**31 - 1))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: unescape(F.substring(formatted, (p["start"] + 1).cast("int"), p["length"].cast("int")))), "")


# ---------------------------------------------------------------- the registered query


def records_of(conversations: DataFrame) -> DataFrame:
    """Conversations (rows by turn) as records of the layout that their roles allow."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    per = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).withColumn("roles", F.expr("transform(t, x -> x.role)"))
    pair, triple = "roles = array('user', 'assistant')", "roles = array('system', 'user', 'assistant')"
    plain = "forall(roles, r -> r IN ('system', 'user', 'assistant')) AND conv_id % 2 = 1"
    renamed = "CASE x.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE x.role END"
    return per.select(
        "conv_id",
        F.expr(f"CASE WHEN {pair} THEN t[0].text WHEN {triple} THEN t[1].text END").alias("prompt"),
        F.expr(f"CASE WHEN {pair} THEN t[1].text WHEN {triple} THEN t[2].text END").alias("response"),
        F.expr(f"CASE WHEN {triple} THEN t[0].text END").alias("system"),
        F.expr(f"CASE WHEN NOT ({pair} OR {triple}) AND {plain} THEN transform(t, x -> named_struct('from', {renamed}, 'value', x.text)) END").alias("conversations"),
        F.expr(f"CASE WHEN NOT ({pair} OR {triple}) AND NOT ({plain}) THEN transform(t, x -> named_struct('role', x.role, 'content', x.text)) END").alias("messages"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, layout, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    chats = canonical_turns(records_of(conversations.select("conv_id", "turn", "role", "text")), "conv_id")
    out = render(chats, "conv_id").select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


#: The conversation that the query adds to the table.
PLANTED = "\\### Assistant: </turn> ok"

ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
),
e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '###', '\\h\\h\\h'), '</turn>', '\\l/turn>') AS body,
    replace(replace(replace(replace(role, '\\', '\\b'), '###', '\\h\\h\\h'), '</turn>', '\\l/turn>'), ':', '\\c') AS head FROM c
),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
