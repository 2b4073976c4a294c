"""What migration scripts leave behind: tables, columns, indexes, constraints, enums and partitions.

Each statement says events of objects (added, changed, dropped), all in one pass. A script's events are dealt by table and put in
order by windows: a dropped table takes all that was said of it before, a dropped column its indexes and constraints. What is left is
aggregated by object: each attribute is that of the last event that sets it, and an object stays if it was added after it was last dropped.

Names are as the server keeps them: quoted ones as they are, others in lower case; schema and table are joined by a dot. Constraints
without a name get the one that the server would give, numbered within the script where several would be the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.functions.numbers import clean_name, dotted_name, type_name

_ONE = r'(?:"(?:[^"]|"")*"|[^\s"]+)'
_NAME = rf"({_ONE}(?: \. {_ONE})*)"
_FIELDS = {
    "kind": "string", "op": "string", "table_name": "string", "name": "string", "base": "string", "data_type": "string", "is_not_null": "boolean", "sets_default": "boolean", "default_expr": "string",
    "con_kind": "string", "is_validated": "boolean", "definition": "string", "columns": "array<string>", "is_unique": "boolean", "is_concurrent": "boolean", "predicate": "string", "labels": "array<string>", "late": "int",
}
_EVENTS = f"array<struct<{', '.join(f'{k}: {t}' for k, t in _FIELDS.items())}>>"
# Words of conditions that name no column.
_WORDS = ("and", "or", "not", "null", "is", "in", "true", "false", "between", "like", "ilike", "similar", "to", "any", "all", "some", "array", "case", "when", "then", "else", "end", "cast", "as", "check", "no", "inherit", "distinct", "from", "collate", "interval")


def _event(when: Column, **given) -> Column:
    value = lambda k: given[k] if isinstance(given.get(k), Column) else F.lit(given.get(k))
    return F.when(when, F.struct(*(value(k).cast(t).alias(k) for k, t in _FIELDS.items())))


def _columns_in(text: Column) -> Column:
    """The names in an expression that are no function's, type's or operator's."""
    bare = F.regexp_replace(F.regexp_replace(text, r"'(?:[^'\\]|''|\\.)*'", "''"), r":: [A-Za-z_][\w$]*", "")
    names = F.regexp_extract_all(bare, F.lit(r'("(?:[^"]|"")*"|(?<![\w$"])[A-Za-z_][\w$]*+(?! \())'), F.lit(1))
    return F.filter(F.array_distinct(F.transform(names, clean_name)), lambda x: ~x.isin(*_WORDS))


def _list(text: Column) -> Column:
    """The names in the first brackets of a constraint."""
    inner = F.regexp_extract(text, r"\( ((?:\"(?:[^\"]|\"\")*\"|[^)\"])*) \)", 1)
    return F.filter(F.transform(F.regexp_extract_all(inner, F.lit(rf"({_ONE})"), F.lit(1)), clean_name), lambda x: x != ",")


def _named(when: Column, table: Column, given: Column, body: Column, column: Column | None = None) -> Column:
    """An added constraint as its statement has it: ``definition`` is its text behind the name, ``base`` the column that it belongs to. ``_constraints``
    tells the rest."""
    return _event(when, kind="constraint", op="add", table_name=table, name=F.when(given != "", clean_name(given)), base=column, definition=body, late=0)


def _constraints(rows: DataFrame) -> DataFrame:
    """Events, the added constraints with kind, columns and the name that the server would give. Each step is a column, so it is taken once a row."""
    added = (F.col("kind") == "constraint") & (F.col("op") == "add")
    body, column, kind, keys = F.col("definition"), F.col("base"), F.col("con_kind"), F.col("columns")
    # the text of a column's constraint is written as the table's would be
    head = F.concat(F.lit(" ( "), column, F.lit(" )"))
    whole = (
        F.when(column.isNull(), body).when(body.rlike("(?i)^REFERENCES"), F.concat(F.lit("FOREIGN KEY"), head, F.lit(" "), body))
        .when(body.rlike("(?i)^PRIMARY KEY"), F.concat(F.lit("PRIMARY KEY"), head)).when(body.rlike("(?i)^UNIQUE"), F.concat(F.lit("UNIQUE"), head)).otherwise(body)
    )
    rows = rows.withColumn("definition", F.when(added, whole).otherwise(body))
    letters = F.create_map(*(F.lit(x) for x in ("PRIMARY KEY", "p", "UNIQUE", "u", "CHECK", "c", "FOREIGN KEY", "f", "EXCLUDE", "x")))
    rows = rows.withColumn("con_kind", F.when(added, letters[F.upper(F.regexp_extract(body, r"(?i)^(PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE)\b", 1))]))
    rows = rows.withColumns({"is_validated": F.when(added, ~body.rlike(r"(?i) NOT VALID$")).otherwise(F.col("is_validated")), "definition": F.when(added, F.regexp_replace(body, r"(?i) NOT VALID$", "")).otherwise(body)})
    rows = rows.withColumn("by_index", F.when(added & kind.isin("p", "u"), F.regexp_extract(body, rf"(?i)^(?:PRIMARY KEY|UNIQUE) USING INDEX {_NAME}", 1)).otherwise(""))
    listed = F.when(kind == "c", _columns_in(body)).when(F.col("by_index") != "", F.array().cast("array<string>")).otherwise(_list(body))
    rows = rows.withColumn("columns", F.when(added, listed).otherwise(keys))
    short = F.try_element_at(F.split("table_name", r"\."), F.lit(-1))
    named = F.array_join(F.when((kind == "c") & column.isNotNull(), F.when(F.size(keys) == 1, F.array(clean_name(column)))).when((kind == "c") & (F.size(keys) != 1), F.array().cast("array<string>")).otherwise(keys), "_")
    ending = F.create_map(*(F.lit(x) for x in ("p", "pkey", "u", "key", "c", "check", "f", "fkey", "x", "excl")))[kind]
    base = F.when(F.col("by_index") != "", dotted_name("by_index")).when(kind == "p", F.concat_ws("_", short, ending)).otherwise(F.concat_ws("_", short, F.nullif(named, F.lit("")), ending))
    return rows.withColumn("base", F.when(added & F.col("name").isNull(), base)).filter(~added | kind.isNotNull()).drop("by_index")


def _column(table: Column, parts: Column, head: Column, asked: set[str]) -> Column:
    """An added column and the constraints in its definition; ``head`` is its name and type."""
    name, rest = F.regexp_extract(head, rf"^({_ONE})", 1), F.regexp_replace(head, rf"^{_ONE} ?", "")
    default = F.try_element_at(F.transform(F.filter(parts, lambda x: x.rlike("(?i)^DEFAULT ")), lambda x: F.regexp_replace(x, "(?i)^DEFAULT ", "")), F.lit(1))
    filled = F.exists(parts, lambda x: x.rlike(r"(?i)^(CONSTRAINT \S+ )?(NOT NULL|PRIMARY KEY)\b"))
    made = _event(F.lit(True), kind="column", op="add", table_name=table, name=clean_name(name), data_type=type_name(rest), is_not_null=filled, sets_default=True, default_expr=default, late=0)
    given = lambda x: F.regexp_extract(x, rf"(?i)^CONSTRAINT ({_ONE})", 1)
    body = lambda x: F.regexp_replace(x, rf"(?i)^CONSTRAINT {_ONE} ", "")
    more = F.transform(F.filter(parts, lambda x: body(x).rlike(r"(?i)^(PRIMARY KEY|UNIQUE|REFERENCES|CHECK)\b")), lambda x: _named(F.lit(True), table, given(x), body(x), name))
    return _joined(F.array(made) if "column" in asked else None, more if "constraint" in asked else None)


def _joined(*lists: Column | None) -> Column:
    there = [x for x in lists if x is not None]
    return F.concat(*there) if len(there) > 1 else there[0] if there else F.lit(None).cast(_EVENTS)


#: The statements that say something of each kind of object.
_SAID_BY = {
    "table": ("create", "drop table"), "column": ("create", "alter", "drop table"), "constraint": ("create", "alter", "drop table"), "partition": ("alter", "drop table"),
    "index": ("index", "alter", "drop index", "drop table"), "enum": ("enum", "value", "drop type"),
}
_VERBS = {
    "create": r"^CREATE (?:(?:GLOBAL|LOCAL|TEMP|TEMPORARY|UNLOGGED) )*TABLE ", "alter": "^ALTER TABLE ", "index": "^CREATE (UNIQUE )?INDEX ", "enum": "^CREATE TYPE .* AS ENUM ",
    "value": "^ALTER TYPE .* ADD VALUE ", "drop table": "^DROP TABLE ", "drop index": "^DROP INDEX ", "drop type": "^DROP TYPE ",
}


def _verbs(kinds: tuple[str, ...], cascades: bool = True) -> list[str]:
    spare = () if cascades or kinds != ("index",) else ("alter",)
    return [v for v in _VERBS if v not in spare and any(v in _SAID_BY[k] for k in kinds)]


def said_by(*kinds: str, cascades: bool = True) -> str:
    """What the statements begin with that matter for these kinds of objects, for ``statements.statements``."""
    return "|".join(_VERBS[v] for v in _verbs(kinds, cascades))


#: The columns of statements that are read here.
READ = ("stmt", "norm", "raw", "items")


def events(stmts: DataFrame, kinds: tuple[str, ...] = tuple(_SAID_BY), cascades: bool = True) -> DataFrame:
    """(file, stmt, pos, and the fields of an event) of all statements, from ``statements.statements``; of some kinds of objects, with the drops of
    tables and columns that touch them. A clause is asked only what its statement and its first words leave open."""
    norm, raw, asked = F.col("norm"), F.col("raw"), set(kinds)
    verbs = _verbs(kinds, cascades)
    verb = F.lit(None).cast("string")
    for v in reversed(verbs):
        verb = F.when(norm.startswith(_VERBS[v][1:].split(" ")[0] + " ") & norm.rlike(_VERBS[v]), v).otherwise(verb)
    first = lambda pattern: dotted_name(F.regexp_extract(raw, rf"(?i){pattern}{_NAME}", 1))
    table = (
        F.when(F.col("verb") == "create", first(_VERBS["create"] + "(?:IF NOT EXISTS )?")).when(F.col("verb") == "alter", first("^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?"))
        .when(F.col("verb") == "index", first(rf"^CREATE (?:UNIQUE )?INDEX (?:CONCURRENTLY )?(?:IF NOT EXISTS )?(?:{_ONE} )?ON (?:ONLY )?"))
        .when(F.col("verb").isin("enum", "value"), first("^(?:CREATE|ALTER) TYPE "))
    )
    rows = stmts.select("file", "stmt", "norm", "raw", "items", verb.alias("verb")).filter("verb IS NOT NULL").withColumn("table_name", table)
    rows = rows.select("*", F.posexplode_outer("items").alias("pos", "item")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    verb, table, c, parts, lead = F.col("verb"), F.col("table_name"), F.col("item.raw"), F.col("item.parts"), F.col("pos") == 0

    one = lambda *of, **given: F.array(_event(F.lit(True), table_name=table, late=0, **given)) if asked & set(of) else F.lit(None).cast(_EVENTS)
    of = lambda pattern: clean_name(F.regexp_extract(c, rf"(?i){pattern}({_ONE})", 1))
    told = lambda pattern: c.rlike(f"(?i){pattern}")
    # constraints of tables, and what a key says of its columns
    text = F.regexp_replace(c, "(?i)^ADD ", "")
    given, body = F.regexp_extract(text, rf"(?i)^CONSTRAINT ({_ONE})", 1), F.regexp_replace(text, rf"(?i)^CONSTRAINT {_ONE} ", "")
    keys = F.when(body.rlike(r"(?i)^PRIMARY KEY \("), F.transform(_list(body), lambda x: _event(F.lit(True), kind="column", op="set", table_name=table, name=x, is_not_null=True, late=1))).otherwise(F.array().cast(_EVENTS))
    ruled = _joined(F.array(_named(F.lit(True), table, given, body)) if "constraint" in asked else None, keys if "column" in asked else None)
    head = F.regexp_replace(F.try_element_at(parts, F.lit(1)), r"(?i)^ADD (?:COLUMN )?(?:IF NOT EXISTS )?", "")
    column = r"^ALTER (?:COLUMN )?"
    create = _column(table, parts, F.try_element_at(parts, F.lit(1)), asked)
    create = F.when(c.isNull(), F.lit(None).cast(_EVENTS)).when(told(r"^(CONSTRAINT|PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE|LIKE)\b"), ruled).otherwise(create)
    if "table" in asked:
        create = F.concat(F.when(lead, F.array(_event(F.lit(True), kind="table", op="add", table_name=table, name=table, late=0))).otherwise(F.array().cast(_EVENTS)), F.coalesce(create, F.array().cast(_EVENTS)))
    typed = one("column", kind="column", op="type", name=of(column), data_type=type_name(F.regexp_replace(F.try_element_at(parts, F.lit(1)), rf"(?i){column}{_ONE} (?:SET DATA )?TYPE ", "")))
    default = one("column", kind="column", op="set", name=of(column), sets_default=True, default_expr=F.nullif(F.regexp_extract(c, rf"(?i){column}{_ONE} SET DEFAULT (.*)$", 1), F.lit("")))
    partition = lambda word: dotted_name(F.regexp_extract(c, rf"(?i)^{word} PARTITION {_NAME}", 1))
    alter = (
        F.when(told("^ADD "), F.when(told(r"^ADD (CONSTRAINT|PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE)\b"), ruled).otherwise(_column(table, parts, head, asked)))
        .when(told("^DROP CONSTRAINT "), one("constraint", kind="constraint", op="drop", name=of("^DROP CONSTRAINT (?:IF EXISTS )?")))
        .when(told("^DROP "), one("column", "index", "constraint", kind="column", op="drop", name=of("^DROP (?:COLUMN )?(?:IF EXISTS )?")))
        .when(
            told("^ALTER "),
            F.when(told(rf"{column}{_ONE} (?:SET|DROP) NOT NULL$"), one("column", kind="column", op="set", name=of(column), is_not_null=told(" SET NOT NULL$")))
            .when(told(rf"{column}{_ONE} (?:SET|DROP) DEFAULT\b"), default).when(told(rf"{column}{_ONE} (?:SET DATA )?TYPE "), typed),
        )
        .when(told("^VALIDATE CONSTRAINT "), one("constraint", kind="constraint", op="set", name=of("^VALIDATE CONSTRAINT "), is_validated=True))
        .when(told("^ATTACH PARTITION "), one("partition", kind="partition", op="add", name=partition("ATTACH"), definition=F.regexp_replace(c, rf"(?i)^ATTACH PARTITION {_NAME} ", "")))
        .when(told("^DETACH PARTITION "), one("partition", kind="partition", op="drop", name=partition("DETACH")))
    )
    index = F.when(lead & norm.rlike(rf"^CREATE (UNIQUE )?INDEX (CONCURRENTLY )?(IF NOT EXISTS )?{_ONE} ON "), one(
        "index", kind="index", op="add", name=first("^CREATE (?:UNIQUE )?INDEX (?:CONCURRENTLY )?(?:IF NOT EXISTS )?"), is_unique=norm.rlike("^CREATE UNIQUE"),
        is_concurrent=norm.rlike("^CREATE (UNIQUE )?INDEX CONCURRENTLY "), definition=F.array_join(F.transform("items", lambda x: x["raw"]), " , "), labels=F.transform("items", lambda x: x["raw"]),
        columns=_columns_in(F.concat_ws(" , ", F.array_join(F.transform("items", lambda x: x["raw"]), " , "), F.regexp_extract(raw, "(?i) WHERE (.*)$", 1))),
        predicate=F.nullif(F.regexp_extract(raw, "(?i) WHERE (.*)$", 1), F.lit("")),
    ))
    listed = dotted_name(F.regexp_replace(c, "(?i) (CASCADE|RESTRICT)$", ""))
    plain = lambda **given: F.array(_event(F.lit(True), late=0, **given))
    said = {
        "alter": alter, "create": create, "index": index, "enum": F.when(lead, plain(kind="enum", op="add", name=table, labels=F.transform("items", lambda x: _unquoted(x["raw"])))),
        "value": plain(kind="enum", op="value", name=table, labels=F.array(_unquoted(F.regexp_extract(raw, r"(?i) ADD VALUE (?:IF NOT EXISTS )?('(?:[^']|'')*')", 1)))),
        "drop table": plain(kind="table", op="drop", table_name=listed, name=listed), "drop index": plain(kind="index", op="drop", name=listed), "drop type": plain(kind="enum", op="drop", name=listed),
    }
    found = F.lit(None).cast(_EVENTS)
    for v in reversed(verbs):
        found = F.when(verb == v, said[v]).otherwise(found)
    rows = rows.select("file", "stmt", "pos", F.explode(found).alias("e")).select("file", "stmt", "pos", "e.*")
    return _constraints(rows) if "constraint" in asked else rows


def _unquoted(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, "^'|'$", ""), F.lit("''"), F.lit("'"))


def graph(stmts: DataFrame, cascades: bool = True, kinds: tuple[str, ...] = tuple(_SAID_BY)) -> DataFrame:
    """One row for each object that a script leaves: file, kind, table_name, name and what of data_type, is_not_null, default_expr, con_kind,
    is_validated, definition, columns, is_unique, is_concurrent, predicate and labels its kind has. Without ``cascades`` a dropped column leaves
    its indexes and constraints as they are. The events of a script meet in one shuffle; every window and grouping below is within a script."""
    at = F.struct("stmt", "late", "pos").alias("at")
    rows = events(stmts, kinds, cascades).repartition("file").select("*", at)
    of_table, nth = Window.partitionBy("file", "table_name"), F.lit(0)
    gone = F.max(F.when((F.col("kind") == "table") & (F.col("op") == "drop"), F.col("at"))).over(of_table)
    lost = F.collect_list(F.when((F.col("kind") == "column") & (F.col("op") == "drop"), F.struct("at", "name"))).over(of_table)
    rows = rows.withColumns({"gone": gone, "lost": lost if cascades and not {"index", "constraint"}.isdisjoint(kinds) else F.array().cast("array<struct<at: struct<stmt: long, late: int, pos: int>, name: string>>")})
    left = F.col("table_name").isNull() | F.col("gone").isNull() | (F.col("at") >= F.col("gone"))
    broken = F.lit(cascades) & F.col("kind").isin("index", "constraint") & F.exists("lost", lambda d: (d["at"] > F.col("at")) & F.array_contains("columns", d["name"]))
    rows = rows.filter(left & ~F.coalesce(broken, F.lit(False))).drop("gone", "lost")
    # unnamed constraints: the second one of a name gets 1 behind it, and so on
    if "constraint" in kinds:
        nth = F.row_number().over(Window.partitionBy("file", "table_name", "base").orderBy("at")) - 1
    rows = rows.withColumn("nth", nth).withColumn("name", F.coalesce("name", F.concat("base", F.when(F.col("nth") > 0, F.col("nth").cast("string")).otherwise(""))))
    owner = F.when(F.col("kind").isin("column", "constraint", "partition"), F.col("table_name"))
    # what was said of an object before it was last dropped is void
    same = Window.partitionBy("file", "kind", "owner", "name")
    rows = rows.withColumn("owner", owner).withColumn("dropped", F.max(F.when(F.col("op") == "drop", F.col("at"))).over(same)).filter("dropped IS NULL OR at > dropped")
    last = lambda field, when: F.max_by(F.when(when, F.struct(field)), F.when(when, F.col("at")))[field].alias(field)
    state = rows.groupBy("file", "kind", "owner", "name").agg(
        F.max(F.when(F.col("op").isin("add", "type"), F.col("at"))).alias("added"),
        *(last(k, F.col("op") == "add") for k in ("table_name", "con_kind", "definition", "columns", "is_unique", "is_concurrent", "predicate", "labels")),
        *(last(k, F.col(k).isNotNull()) for k in ("data_type", "is_not_null", "is_validated")), last("default_expr", F.coalesce("sets_default", F.lit(False))),
        F.sort_array(F.collect_list(F.when(F.col("op") == "value", F.struct("at", "labels")))).alias("more"),
    )
    state = state.filter("added IS NOT NULL")
    more = F.flatten(F.transform(F.filter("more", lambda x: x["at"] > F.col("added")), lambda x: x["labels"]))
    return state.select(
        "file", "kind", F.coalesce("owner", "table_name").alias("table_name"), "name", "data_type", F.when(F.col("kind") == "column", F.coalesce("is_not_null", F.lit(False))).alias("is_not_null"), "default_expr",
        "con_kind", "is_validated", "definition", "columns", "is_unique", "is_concurrent", "predicate", F.when(F.col("kind") == "enum", F.array_distinct(F.concat("labels", more))).otherwise(F.col("labels")).alias("labels"),
    )


def ddl_tables(stmts: DataFrame) -> DataFrame:
    """(file, table_name) of tables that a script creates and leaves."""
    return graph(stmts, kinds=("table",)).filter("kind = 'table'").select("file", "table_name")


def ddl_columns(stmts: DataFrame) -> DataFrame:
    """(file, table_name, column_name, data_type, is_not_null, default_expr)."""
    return graph(stmts, kinds=("column",)).filter("kind = 'column'").select("file", "table_name", F.col("name").alias("column_name"), "data_type", "is_not_null", "default_expr")


def ddl_indexes(stmts: DataFrame, cascades: bool = True) -> DataFrame:
    """(file, index_name, table_name, is_unique, is_concurrent, key_columns, predicate), by what the statements on indexes say; with ``cascades``
    without those that a dropped column takes as well."""
    return graph(stmts, cascades, ("index",)).filter("kind = 'index'").select("file", F.col("name").alias("index_name"), "table_name", "is_unique", "is_concurrent", F.col("labels").alias("key_columns"), "predicate")


def ddl_constraints(stmts: DataFrame) -> DataFrame:
    """(file, table_name, constraint_name, kind, is_validated, definition), those of columns and without a name as well."""
    return graph(stmts, kinds=("constraint",)).filter("kind = 'constraint'").select("file", "table_name", F.col("name").alias("constraint_name"), F.col("con_kind").alias("kind"), "is_validated", "definition")


def ddl_enums(stmts: DataFrame) -> DataFrame:
    """(file, enum_name, labels). Values added BEFORE or AFTER another stand behind as well: the labels are a set for the differences."""
    return graph(stmts, kinds=("enum",)).filter("kind = 'enum'").select("file", F.col("name").alias("enum_name"), "labels")


def ddl_partitions(stmts: DataFrame) -> DataFrame:
    """(file, table_name, partition_name, bound)."""
    return graph(stmts, kinds=("partition",)).filter("kind = 'partition'").select("file", "table_name", F.col("name").alias("partition_name"), F.col("definition").alias("bound"))
