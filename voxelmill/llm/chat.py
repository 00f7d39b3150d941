"""Chat formatting: records of many layouts to canonical turns, and turns to training text.

A record is JSON. A `Mapping` declares the nested field paths of a layout, such as `data.prompt` or
`messages[].role`, and where its turns are. Of a record those paths that any mapping names, and that hold
what such a path holds, a text or a list of objects, are hashed to the fingerprint of its layout; fields that
no mapping names are ignored, wherever they are. The fingerprint selects the mapping: that whose declared
paths, with some of its optional ones, have it. Turns (role, text) are written in one template:

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts `&`, `<` and `[` (and, in roles, a line end) are written as entities, so no control
string of this or another template can stand in them, and reading back gives exactly what was written.
The loss mask is a list of offsets in code points: for each turn how many to skip, how many its text takes,
and whether they count, as those of assistants do.

Spark's variants hold 128 MiB and their parser texts of 20 million characters. Of a longer record the layout is
that of its skeleton, the record with empty texts and runs of equal objects once, and its values are read with a
schema instead; so a record may be as long as a string.

Everything is built of Spark's own expressions. A null text or role is empty. A record that is null, no
JSON, or of paths that no mapping declares together has null turns and null outputs, beside its fingerprint. A conversation without turns is an
empty text. Repeated rows are turns of their own; ties of the turn number go by role, then text. Other columns
of conversations aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What stands for what inside roles and texts; `&` is first when written, last when read.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]
IN_ROLES = [("\n", "&nl;")]
#: Bytes of a record that surely fits a variant, with room for its offsets.
LARGE = 1 << 24
TURN = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: either texts at paths for each turn, or a list of messages.

    fields: (paths, role) in the order of turns; texts of several paths are one, with a blank line between.
    Paths in `optional` may be missing, null or empty; a turn without any text of such paths is none.
    messages: (path of the list, role field, text field); roles: (role as written, canonical role).
    """

    name: str
    fields: tuple[tuple[tuple[str, ...], str], ...] = ()
    optional: tuple[str, ...] = ()
    messages: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def under(self, wrapper: str) -> Mapping:
        """The same layout inside of an object."""
        inside = lambda path: f"{wrapper}.{path}"
        fields = tuple((tuple(map(inside, paths)), role) for paths, role in self.fields)
        return replace(self, fields=fields, optional=tuple(map(inside, self.optional)), messages=self.messages and (inside(self.messages[0]), *self.messages[1:]))

    def paths(self) -> list[str]:
        if self.messages:
            path, role, text = self.messages
            return [path, f"{path}[].{role}", f"{path}[].{text}"]
        return [p for paths, _ in self.fields for p in paths]

    def layouts(self) -> list[list[str]]:
        """The sets of paths that select this mapping; a list of messages may be empty."""
        if self.messages:
            return [self.paths(), self.paths()[:1]]
        needed = [p for p in self.paths() if p not in self.optional]
        return [[*needed, *some] for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]

    def turns(self, record: Column) -> Column:
        """Of a variant."""
        if self.messages:
            path, role, text = self.messages
            return self.spoken(F.try_variant_get(record, f"$.{path}", f"array<struct<{role}: string, {text}: string>>"))
        return self.fielded(lambda path: F.try_variant_get(record, f"$.{path}", "string"))

    def long_turns(self, record: Column) -> Column:
        """Of JSON of any length."""
        options = {"maxStringLen": str((1 << 31) - 1)}
        if self.messages:
            path, role, text = self.messages
            return self.spoken(at_path(F.from_json(record, schema_of({path: f"array<struct<`{role}`: string, `{text}`: string>>"}), options), path))
        read = F.from_json(record, schema_of(dict.fromkeys(self.paths(), "string")), options)
        return self.fielded(lambda path: at_path(read, path))

    def spoken(self, got: Column) -> Column:
        _, role, text = self.messages
        said = lambda m: F.coalesce(m[role], F.lit(""))
        return F.transform(got, lambda m: F.struct(self.canonical(said(m)).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))

    def fielded(self, of) -> Column:
        each = []
        for paths, role in self.fields:
            some = lambda path: F.when(F.length(of(path)) > 0, of(path)) if path in self.optional else F.coalesce(of(path), F.lit(""))
            text = some(paths[0]) if len(paths) == 1 else F.array_join(F.array(*map(some, paths)), "\n\n")
            turn = F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
            each.append(F.when(text.isNotNull(), F.array(turn)).otherwise(F.array().cast(TURN)) if set(paths) <= set(self.optional) else F.array(turn))
        return F.concat(*each)

    def canonical(self, role: Column) -> Column:
        for written, meant in self.roles:
            role = F.when(role == written, meant).otherwise(role) if written else role
        return role


def at_path(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value[name]
    return value


def schema_of(kinds: dict[str, str]) -> str:
    """The schema of an object with values of the given types at nested paths."""
    inner: dict[str, dict[str, str]] = {}
    for path, kind in kinds.items():
        name, _, rest = path.partition(".")
        inner.setdefault(name, {})[rest] = kind
    return ", ".join(f"`{name}` {of['']}" if "" in of else f"`{name}` struct<{schema_of(of).replace('` ', '`: ', 1) if len(of) == 1 else nested(of)}>" for name, of in inner.items())


def nested(kinds: dict[str, str]) -> str:
    return ", ".join(schema_of({p: k}).replace("` ", "`: ", 1) for p, k in kinds.items())


PLAIN = [
    Mapping("messages", messages=("messages", "role", "content")),
    Mapping("shared", messages=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", fields=((("prompt",), "user"), (("response",), "assistant"))),
    Mapping("completion", fields=((("prompt",), "user"), (("completion",), "assistant"))),
    Mapping("instruction", fields=((("system",), "system"), (("instruction", "input"), "user"), (("output",), "assistant")), optional=("system", "input")),
    Mapping("question", fields=((("system",), "system"), (("question",), "user"), (("answer",), "assistant")), optional=("system",)),
]
#: The layouts as they are and inside of an object.
MAPPINGS = [*PLAIN, *[m.under(w) for w in ("data", "record") for m in PLAIN]]


def paths_of(record: Column, mappings: list[Mapping]) -> Column:
    """Of a variant the nested paths, sorted, that mappings name and that hold a text (or any value but an object or a list) or a list of messages."""
    kind = lambda v: F.schema_of_variant(v)
    plain = lambda v: ~(kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY"))
    of: dict[str, Column] = {}
    for m in mappings:
        if m.messages:
            path, *fields = m.messages
            items = F.try_variant_get(record, f"$.{path}", "array<variant>")
            of[path] = kind(F.try_variant_get(record, f"$.{path}", "variant")).startswith("ARRAY")
            for f in fields:
                values = F.transform(items, field(f))
                of[f"{path}[].{f}"] = F.exists(values, lambda v: v.isNotNull()) & F.forall(values, lambda v: F.coalesce(plain(v), F.lit(True)))
        else:
            of |= {path: plain(F.try_variant_get(record, f"$.{path}", "variant")) for path in m.paths()}
    return F.array_compact(F.array(*[F.when(there, F.lit(path)) for path, there in sorted(of.items())]))


def field(name: str):
    return lambda item: F.try_variant_get(item, f"$.{name}", "variant")


def fingerprint_of(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def skeleton(record: Column) -> Column:
    """The JSON with every text empty and of equal objects in a row one, which has the same layout. All quantifiers are possessive."""
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    marked = F.regexp_replace(record, rf"({string}\s*+:)|{string}", "$1\x01")
    bare = F.replace(F.replace(marked, F.lit(":\x01"), F.lit(":")), F.lit("\x01"), F.lit('""'))
    return F.regexp_replace(bare, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def to_turns(records: DataFrame, record: str = "record", mappings: list[Mapping] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keep, fingerprint, layout, turns) of each JSON record; layout names the mapping. The fingerprint of what is no JSON is null."""
    mappings = MAPPINGS if mappings is None else mappings
    keep = [c for c in records.columns if c != record] if keep is None else keep
    long = F.octet_length(F.col(record)) > LARGE
    parsed = records.select(*keep, F.col(record).alias("__r"), long.alias("__long"), F.try_parse_json(F.when(long, skeleton(F.col(record))).otherwise(F.col(record))).alias("__v"))
    parsed = parsed.withColumn("fingerprint", F.when(F.col("__v").isNotNull(), fingerprint_of(paths_of(F.col("__v"), mappings))))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for m in mappings:
        own = F.col("fingerprint").isin(*[fingerprint_of(F.array(*[F.lit(p) for p in sorted(s)])) for s in m.layouts()])
        name, turns = F.when(own, m.name).otherwise(name), F.when(own & F.col("__long"), m.long_turns(F.col("__r")).cast(TURN)).when(own, m.turns(F.col("__v")).cast(TURN)).otherwise(turns)
    return parsed.select(*keep, "fingerprint", name.alias("layout"), turns.alias("turns"))


def written(text: Column, more: list[tuple[str, str]] | None = None) -> Column:
    for raw, entity in [*ENTITIES, *(more or [])]:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def read_back(text: Column, more: list[tuple[str, str]] | None = None) -> Column:
    for raw, entity in reversed([*ENTITIES, *(more or [])]):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """`turns` with `formatted` and its loss mask (skip, take, loss), in code points, in place of turns."""
    head = lambda t: F.concat(F.lit(START), written(t["role"], IN_ROLES), F.lit("\n"))
    each = F.transform("turns", lambda t: F.struct(head(t).alias("head"), written(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    after = lambda k: F.when(k > 0, len(END)).otherwise(0)
    mask = F.transform("__each", lambda e, k: F.struct((after(k) + F.length(e["head"])).alias("skip"), F.length(e["text"]).alias("take"), e["loss"].alias("loss")))
    out = turns.withColumn("__each", each).withColumn("formatted", F.array_join(F.transform("__each", lambda e: F.concat(e["head"], e["text"], F.lit(END))), ""))
    return out.withColumn("mask", mask).drop("turns", "__each")


def pieces_of(formatted: Column) -> Column:
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))


def turns_of(formatted: Column) -> Column:
    """The turns that a formatted text was made of."""
    head = lambda p: F.substring_index(p, "\n", 1)
    role = lambda p: read_back(F.substring(head(p), len(START) + 1, 1 << 30), IN_ROLES)
    text = lambda p: read_back(F.substr(p, F.length(head(p)) + 2))
    return F.transform(pieces_of(formatted), lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, cut out of the formatted text by its offsets, as it was before it was written.

    A skip begins at the end of the text before; pieces between turns' ends keep that linear in the text.
    """
    cuts = F.transform(F.arrays_zip(pieces_of(formatted).alias("piece"), mask.alias("m")), lambda z, k: F.when(
        z["m"]["loss"], read_back(F.substr(z["piece"], z["m"]["skip"] - F.when(k > 0, len(END)).otherwise(0) + 1, z["m"]["take"]))
    ))
    return F.array_join(cuts, "")


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation in a layout that can hold it, as its roles and id have it."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles, text = F.transform("t", lambda x: x["role"]), lambda k: F.col("t")[k]["text"]
    are = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    named = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system")])
    shared = F.to_json(F.struct(F.transform("t", lambda x: F.struct(named[x["role"]].alias("from"), x["text"].alias("value"))).alias("conversations")))
    answered = F.struct(text(0).alias("prompt"), text(1).alias("response"))
    prompt = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.to_json(F.struct(answered.alias("data"), F.lit("log").alias("source")))).otherwise(F.to_json(answered))
    instruction = F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    record = F.when(are("user", "assistant"), prompt).when(are("system", "user", "assistant") & (F.length(text(0)) > 0), instruction).when(plain & (F.pmod("conv_id", F.lit(2)) == 0), shared).otherwise(messages)
    return whole.select("conv_id", record.alias("record"))


def chat_query(conversations: DataFrame) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{own}'), (-7L, 1L, 'assistant', '{own}') AS t(conv_id, turn, role, text)")
    done = format_turns(to_turns(as_records(conversations.select("conv_id", "turn", "role", "text").unionByName(more))))
    back = done.select("conv_id", "layout", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(spoken).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"), "formatted_chars", "layout",
    )


CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t(conv_id, turn, role, text)
), sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;')) + 24 AS n FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n) AS formatted_chars,
    string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles, bool_and(role IN ('user', 'assistant', 'system')) AS plain,
    first(text ORDER BY turn NULLS FIRST, role, text) AS opening
  FROM sized GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(spoken) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  CASE WHEN roles = 'user,assistant' THEN 'prompt' WHEN roles = 'system,user,assistant' AND opening <> '' THEN 'instruction' WHEN plain AND conv_id % 2 = 0 THEN 'shared' ELSE 'messages' END AS layout
FROM whole
"""
