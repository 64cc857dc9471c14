"""The engine: scripts of SQL statements over declared tables, and results as Arrow."""

from __future__ import annotations

import importlib
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import dialect
from millrace.catalog import Catalog, FunctionDef, ModelDef, Table, View
from millrace.errors import Refused
from millrace.operators import cep, keyed, ml, vector
from millrace.sources import connectors
from millrace.types import parse_type, split_top


@dataclass
class Result:
    statement: str
    data: DataFrame | None = None
    message: str = ""

    def arrow(self) -> pa.Table:
        if self.data is None:
            raise Refused(f"no rows: {self.statement}")
        return self.data.toArrow()

    def batches(self) -> Iterable[pa.RecordBatch]:
        return self.arrow().to_batches()


class Engine:
    """strict refuses what the engine leaves out; without it Spark's own SQL is taken as it is."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, strict: bool = True):
        self.spark, self.catalog, self.strict = spark.newSession(), catalog or Catalog(), strict
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        self.table_functions: dict[str, tuple[Callable, str]] = {}
        self.statistics: dict[str, dict] = {}
        self.streaming = False
        for signature, result, body in dialect.FUNCTIONS:
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")

    # Statements

    def run_script(self, script: str) -> list[Result]:
        return [self.execute(s) for s in dialect.statements(script)]

    def query(self, sql: str) -> DataFrame:
        return self._select(sql)

    def execute(self, sql: str) -> Result:
        for pattern, run in (
            (r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|MATERIALIZED|MODEL|FUNCTION|AGGREGATE)\b", self._create),
            (r"ALTER\s+TABLE\b", self._alter),
            (r"DROP\b", self._drop),
            (r"SHOW\s+TABLES\b", lambda s: Result(s, self.spark.createDataFrame([(t.name,) for t in self.catalog.entries["table"].values()], "name string"))),
            (r"REFRESH\s+MATERIALIZED\s+VIEW\b", self._refresh),
            (r"ANALYZE\s+TABLE\b", self._analyze),
            (r"EXPLAIN\b", self._explain),
            (r"INSERT\s+INTO\b", self._insert),
            (r"(SELECT|WITH|\()", lambda s: Result(s, self._select(s))),
        ):
            if re.match(pattern, sql, re.I):
                return run(sql)
        raise Refused(f"unknown statement: {sql[:60]}")

    def _create(self, sql: str) -> Result:
        held = dialect.Held(sql)
        text = held.text
        replace = bool(re.match(r"CREATE\s+OR\s+REPLACE", text, re.I))
        if m := re.match(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\(", text, re.I):
            end = dialect.closing(text, m.end() - 1)
            if re.match(r"CREATE\s+TABLE\s+IF\b", text, re.I) and self.catalog.find("table", m[1]):
                return Result(sql, message=f"table {m[1]} exists")
            columns, key, given = [], [], {}
            for part in split_top(held.back(text[m.end() : end])):
                if k := re.match(r"\s*(?:CONSTRAINT\s+\w+\s+)?PRIMARY\s+KEY\s*\(([^)]*)\)", part, re.I):
                    key += [c.strip() for c in k[1].split(",")]
                    continue
                if k := re.fullmatch(r"\s*WATERMARK\s+FOR\s+(\w+)\s+AS\s+\1\s*(?:-\s*(INTERVAL\s+.+?))?\s*", part, re.I | re.S):
                    given = {"event_time_column": k[1], "watermark_lag_ms": str(dialect.millis(k[2], dialect.Held("")) if k[2] else 0)}
                    continue
                if re.match(r"\s*(WATERMARK\s+FOR|CONSTRAINT|CHECK|UNIQUE|FOREIGN\s+KEY)\b", part, re.I):
                    raise Refused(f"not supported in a table: {part.strip()}")
                name, kind = part.strip().split(None, 1)
                if re.search(r"\bPRIMARY\s+KEY\b", kind, re.I):
                    key.append(name)
                columns.append((name, re.sub(r"\s+(NOT\s+NULL|PRIMARY\s+KEY(\s+NOT\s+ENFORCED)?)", "", kind, flags=re.I).strip()))
            w = re.search(r"\bWITH\s*\((.*)\)\s*$", held.back(text[end + 1 :]), re.I | re.S)
            options = given | (dialect.options(w[1]) if w else {})
            key = key or [c.strip() for c in options.get("primary_key", "").split(",") if c.strip()]
            if unknown := {*key, *given.values()} - {n for n, _ in columns} - {given.get("watermark_lag_ms")}:
                raise Refused(f"table {m[1]} has no column {', '.join(sorted(unknown))}")
            self.catalog.add("table", Table(m[1], columns, options, key))
            return Result(sql, message=f"table {m[1]}")
        if m := re.match(r"CREATE\s+(?:OR\s+REPLACE\s+)?(MATERIALIZED\s+)?VIEW\s+(\w+)\s*(?:\(([^)]*)\)\s*)?(?:WITH\s*\(([^()]*)\)\s*)?AS\s+", text, re.I):
            body = held.back(text[m.end() :])
            view = View(m[2], body, [c.strip() for c in (m[3] or "").split(",") if c.strip()], bool(m[1]), dialect.options(held.back(m[4])) if m[4] else {})
            if not re.search(rf"\b(FROM|JOIN)\s+{re.escape(m[2])}\b", text[m.end() :], re.I):
                self._select(body)  # a view that doesn't bind is no view
            elif self.catalog.find("view", m[2]) is None or replace:
                raise Refused(f"view {m[2]} would read itself")
            self.catalog.add("view", view, replace)
            return self._refresh(f"REFRESH MATERIALIZED VIEW {m[2]}") if m[1] else Result(sql, message=f"view {m[2]}")
        if m := re.match(r"CREATE\s+MODEL\s+(\w+)\s+INPUT\s*\((.*?)\)\s*OUTPUT\s*\((.*?)\)\s*WITH\s*\((.*)\)\s*$", held.back(text), re.I | re.S):
            fields = lambda s: [tuple(p.strip().split(None, 1)) for p in split_top(s)]
            self.catalog.add("model", ModelDef(m[1], fields(m[2]), fields(m[3]), dialect.options(m[4])), replace)
            return Result(sql, message=f"model {m[1]}")
        if m := re.match(r"CREATE\s+(?:OR\s+REPLACE\s+)?AGGREGATE\s+(\w+)\s*\((.*?)\)\s*RETURNS\s+(.+?)\s+LANGUAGE\s+(\w+)\s+AS\s+'([\w.]+):(\w+)'\s*$", held.back(text), re.I | re.S):
            if m[4].lower() != "python":
                raise Refused(f"aggregates are Python functions, not {m[4]}")
            from millrace.functions.aggregates import REGISTRY

            if m[1].lower() in REGISTRY and not replace:
                raise Refused(f"{m[1]} exists")
            for part in split_top(m[2]):
                parse_type(part.strip().split(None, 1)[-1])
            try:
                function = getattr(importlib.import_module(m[5]), m[6])
            except (ImportError, AttributeError) as e:
                raise Refused(f"no function {m[5]}:{m[6]}") from e
            self.register_aggregate(m[1], function, m[3])
            return Result(sql, message=f"aggregate {m[1]}")
        if m := re.match(r"CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(\w+)\s*\((.*?)\)\s*RETURNS\s+(.+?)\s+LANGUAGE\s+(\w+)\s+AS\s+(.+)$", held.back(text), re.I | re.S):
            if m[4].lower() != "sql":
                raise Refused(f"functions in {m[4]} are registered from Python")
            body = m[5].strip()
            body = body[2:-2] if body.startswith("$$") else body[1:-1].replace("''", "'") if body.startswith("'") else body
            body = re.sub(r"^\s*SELECT\s+", "", body, flags=re.I)
            arguments = [tuple(p.strip().split(None, 1)) for p in split_top(m[2]) if p.strip()]
            f = FunctionDef(m[1], arguments, m[3], "sql", body)
            if self.catalog.find("function", m[1]) and not replace:
                raise Refused(f"{m[1]} exists")
            kind = lambda t: parse_type(t).simpleString()
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m[1]}({', '.join(f'{n} {kind(t)}' for n, t in arguments)}) RETURNS {kind(m[3])} RETURN {dialect.functions(body)}")
            self.catalog.add("function", f, True)
            return Result(sql, message=f"function {m[1]}")
        raise Refused(f"unknown statement: {sql[:60]}")

    def _alter(self, sql: str) -> Result:
        m = re.match(r"ALTER\s+TABLE\s+(\w+)\s+(.*)$", sql, re.I | re.S)
        table, rest = self.catalog.get("table", m[1]), m[2].strip()
        names = [n for n, _ in table.columns]

        def at(name: str) -> int:
            if name not in names:
                raise Refused(f"table {table.name} has no column {name}")
            return names.index(name)

        if a := re.match(r"ADD\s+(?:COLUMN\s+)?(\w+)\s+(.+)$", rest, re.I | re.S):
            if a[1] in names:
                raise Refused(f"column {a[1]} exists")
            parse_type(a[2])
            table.columns.append((a[1], a[2].strip()))
        elif a := re.match(r"DROP\s+(?:COLUMN\s+)?(\w+)$", rest, re.I):
            if a[1] in table.primary_key or len(names) == 1:
                raise Refused(f"column {a[1]} can't go")
            del table.columns[at(a[1])]
        elif a := re.match(r"ALTER\s+(?:COLUMN\s+)?(\w+)\s+(?:SET\s+DATA\s+)?TYPE\s+(.+)$", rest, re.I | re.S):
            parse_type(a[2])
            table.columns[at(a[1])] = (a[1], a[2].strip())
        elif a := re.match(r"RENAME\s+COLUMN\s+(\w+)\s+TO\s+(\w+)$", rest, re.I):
            if a[2] in names:
                raise Refused(f"column {a[2]} exists")
            table.columns[at(a[1])] = (a[2], table.columns[at(a[1])][1])
            table.primary_key = [a[2] if k == a[1] else k for k in table.primary_key]
        elif a := re.match(r"RENAME\s+TO\s+(\w+)$", rest, re.I):
            self.catalog.rename("table", m[1], a[1])
        elif a := re.match(r"SET\s*\((.*)\)$", rest, re.I | re.S):
            table.options |= dialect.options(a[1])
        elif a := re.match(r"RESET\s*\((.*)\)$", rest, re.I | re.S):
            for k in a[1].split(","):
                table.options.pop(k.strip().strip("'\"").lower(), None)
        else:
            raise Refused(f"unknown statement: {sql[:60]}")
        self.catalog.save()
        return Result(sql, message=f"table {table.name}")

    def _drop(self, sql: str) -> Result:
        m = re.match(r"DROP\s+(TABLE|MATERIALIZED\s+VIEW|VIEW|MODEL|FUNCTION)\s+(IF\s+EXISTS\s+)?(\w+)", sql, re.I)
        if not m:
            raise Refused(f"unknown statement: {sql[:60]}")
        kind = re.sub(r"\s+", " ", m[1].lower())
        gone = self.catalog.drop("view" if "view" in kind else kind, m[3], bool(m[2]), None if "view" not in kind else kind != "view")
        if kind == "function" and gone:
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {m[3]}")
        return Result(sql, message=f"dropped {m[3]}" if gone else f"no {m[3]}")

    def _refresh(self, sql: str) -> Result:
        """Rebuild a materialized view from its query into a new stored table, and only then show that one."""
        from millrace.storage import new_path

        view = self.catalog.get("view", sql.split()[-1])
        if not view.materialized:
            raise Refused(f"{view.name} is no materialized view")
        path = new_path(self.spark, f"view-{view.name}")
        out = self._select(view.sql)
        (out.toDF(*view.columns) if view.columns else out).write.parquet(path)
        view.options["path"] = path
        self.catalog.save()
        return Result(sql, message=f"view {view.name}")

    def _analyze(self, sql: str) -> Result:
        """Row count, and distinct values and NULLs of columns; kept for EXPLAIN and written to the table's options."""
        m = re.match(r"ANALYZE\s+TABLE\s+(\w+)\s*(?:\(([^)]*)\))?", sql, re.I)
        table = self.catalog.get("table", m[1])
        columns = [c.strip() for c in m[2].split(",")] if m[2] else [n for n, k in table.columns if not isinstance(parse_type(k), T.MapType | T.ArrayType | T.StructType)]
        row = self._table(table.name).agg(F.count("*").alias("row_count"), *[F.approx_count_distinct(c).alias(f"ndv_{c}") for c in columns], *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"nulls_{c}") for c in columns]).first().asDict()
        table.options |= {k: str(v or 0) for k, v in row.items()}
        self.statistics[table.name] = row
        self.catalog.save()
        return Result(sql, self.spark.createDataFrame([(k, int(v or 0)) for k, v in row.items()], "name string, value long"))

    def _explain(self, sql: str) -> Result:
        body = re.sub(r"^EXPLAIN\s+", "", sql, flags=re.I)
        if m := re.match(r"INSERT\s+INTO\s+(\w+)\s*(?:\([^)]*\)\s*)?(?=SELECT|WITH)", body, re.I):
            body = body[m.end() :]
        text = self._select(body)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))
        return Result(sql, self.spark.createDataFrame([(x,) for x in text.splitlines()], "plan string"))

    def _insert(self, sql: str) -> Result:
        m = re.match(r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\)\s*)?(?=SELECT|WITH|\()", sql, re.I)
        table = self.catalog.get("table", m[1])
        rows = self._select(sql[m.end() :])
        targets = [c.strip() for c in m[2].split(",")] if m[2] else [n for n, _ in table.columns]
        kinds = table.types()
        if unknown := [c for c in targets if c not in kinds]:
            raise Refused(f"table {table.name} has no columns {', '.join(unknown)}")
        if len(rows.columns) != len(targets):
            raise Refused(f"{len(rows.columns)} columns into {len(targets)} of {table.name}")
        if table.primary_key and not set(table.primary_key) <= set(targets):
            raise Refused(f"the primary key of {table.name} has to be written")
        out = rows.toDF(*targets)
        columns = []
        for n, k in table.columns:
            want = parse_type(k)
            if n not in targets:
                columns.append(F.lit(None).cast(want).alias(n))
                continue
            have = out.schema[n].dataType
            if have != want and not _assignable(have, want):
                raise Refused(f"column {n} of {table.name}: {have.simpleString()} into {want.simpleString()}")
            columns.append(F.col(f"`{n}`").cast(want).alias(n))
        mode = table.options.get("mode", "append")
        return Result(sql, connectors.write(out.select(*columns), table, mode, table.options.get("delivery")), f"into {table.name}")

    # Functions from Python

    def register_function(self, name: str, function: Callable, kind: str) -> None:
        """A scalar function over Arrow batches: pandas series to a series."""
        self.spark.udf.register(name, F.pandas_udf(function, parse_type(kind)))

    def register_aggregate(self, name: str, function: Callable, kind: str) -> None:
        """An aggregate: pandas series of a group to a value. Rows with a NULL argument are left out."""
        from millrace.functions import aggregates

        aggregates.register_aggregate(name, parse_type(kind).simpleString(), function)
        self.spark.udf.register(name, aggregates.aggregate_udf(name))

    def lineage(self, sql: str) -> dict[str, set[str]]:
        from millrace.lineage import lineage

        return lineage(self._select(sql))

    # Streams

    def stream(self, sql: str, checkpoint: str | None = None, every: str | None = None):
        """Run an INSERT as a stream over what is available now, or until stopped if `every` names an interval; a query handle.

        A file sink with `delivery` = 'exactly_once' takes each batch once, also after a restart from the checkpoint.

        Tables with `unbounded` = 'true' are read as streams, with the watermark of their
        `event_time_column` and `watermark_lag_ms`. State that only grows is refused, unless the
        sink has a `state_ttl` or the statement ends with ALLOW UNBOUNDED STATE.
        """
        from millrace.streaming import runtime

        m = re.match(r"INSERT\s+INTO\s+(\w+)\s*(?=SELECT|WITH|\()", sql, re.I)
        if not m:
            raise Refused("a stream is an INSERT INTO ... SELECT")
        table, body = self.catalog.get("table", m[1]), sql[m.end() :]
        if not re.search(r"\bALLOW\s+UNBOUNDED\s+STATE\s*$", body, re.I) and "state_ttl" not in table.options and (why := dialect.unbounded_state(body)):
            raise Refused(f"{why} keeps state for ever; give the sink a state_ttl or end with ALLOW UNBOUNDED STATE")
        self.streaming = True
        try:
            rows = self._select(body)
        finally:
            self.streaming = False
        names = [n for n, _ in table.columns]
        keeps = bool(re.search(r"\bGROUP\s+BY\b", dialect.Held(body).text, re.I))
        mode = table.options.get("output", "update" if keeps and table.primary_key else "append")
        rows, write_mode, delivery = rows.toDF(*names), table.options.get("mode", "append"), table.options.get("delivery")
        connectors.check_sink(table, write_mode, delivery)
        if delivery == "exactly_once":
            if table.options["connector"] not in connectors.FILES or write_mode != "append" or mode != "append":
                raise Refused(f"a stream is written exactly once to files, in append mode: {table.name}")
            if not checkpoint:
                raise Refused("exactly-once needs a checkpoint")
            return runtime.start_files(rows, connectors.place(table), connectors.file_format(table), checkpoint, every, connectors.partitions(table), connectors.file_options(table))
        return runtime.start(rows, lambda batch, number: connectors.write(batch, table, write_mode), mode, checkpoint, every)

    # Queries

    def _table(self, name: str) -> DataFrame:
        if view := self.catalog.find("view", name):
            if view.materialized:
                return self.spark.read.parquet(view.options["path"])
            out = self._select(view.sql)
            return out.toDF(*view.columns) if view.columns else out
        table = self.catalog.get("table", name)
        live = self.streaming and table.options.get("unbounded", "").lower() == "true"
        rows = connectors.read(self.spark, table, live)
        if live and (ts := table.options.get("event_time_column")):
            lag = int(table.options.get("watermark_lag_ms", "0"))
            rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{lag} milliseconds")
        return rows

    def _select(self, sql: str) -> DataFrame:
        sql = re.sub(r"\bALLOW\s+UNBOUNDED\s+STATE\s*$", "", sql.strip(), flags=re.I)
        if self.strict:
            dialect.refuse(sql)
        names = set(re.findall(r"\b\w+\b", dialect.Held(sql).text.lower()))
        used = names & (self.catalog.entries["table"].keys() | self.catalog.entries["view"].keys())
        for name in used:
            self._table(name).createOrReplaceTempView(name)
        sql = dialect.islands(sql, {"match_recognize": self._match, "ml_predict": self._ml, "vector_search": self._vectors, "table_function": self._table_function})
        sql = dialect.functions(dialect.top_n(sql))
        out = self.spark.sql(dialect.windows(sql, lambda column: self._is_millis(used, column)))
        if re.match(r"SELECT\s+\*\s+FROM\s+\w+[^()]*\bJOIN\b", dialect.Held(sql).text.strip(), re.I):
            attributes = out._jdf.queryExecution().analyzed().output()
            named = [attributes.apply(k) for k in range(attributes.size())]
            out = out.toDF(*[f"{a.qualifier().last()}_{a.name()}" if a.qualifier().nonEmpty() else a.name() for a in named])
        return out

    def _is_millis(self, names: set[str], column: str) -> bool:
        """Whether a column of the tables that a query names is a number: epoch milliseconds."""
        kinds = {f.dataType for n in names for f in self.spark.table(n).schema if f.name.lower() == column.lower()}
        return bool(kinds) and all(isinstance(k, T.LongType | T.IntegerType) for k in kinds)

    def _view(self, df: DataFrame) -> str:
        df.createOrReplaceTempView(name := f"island_{uuid.uuid4().hex}")
        return name

    def register_table_function(self, name: str, function: Callable, schema: str) -> None:
        """function(row, state) gives rows; see keyed.process_table."""
        self.table_functions[name.lower()] = (function, schema)

    def _table_function(self, name: str, table: str, keys: list[str]) -> str:
        if name.lower() not in self.table_functions:
            raise Refused(f"unknown table function {name}")
        rows = self.spark.table(table)
        function, schema = self.table_functions[name.lower()]
        order = [F.col(f.name) for f in rows.schema if f.name not in keys and not isinstance(f.dataType, T.MapType)]
        return self._view(keyed.process_table(rows, keys, order, function, schema))

    def _ml(self, body: str) -> str:
        m = re.match(r"\s*TABLE\s+(\w+)\s*,\s*MODEL\s+(\w+)\s*,\s*DESCRIPTOR\s*\(([^)]*)\)\s*$", body, re.I)
        if not m:
            raise Refused(f"ML_PREDICT(TABLE t, MODEL m, DESCRIPTOR(columns)): {body}")
        d = self.catalog.get("model", m[2])
        rest = dict(d.options)
        model = ml.Model(d.name, d.inputs, d.outputs, rest.pop("provider", "http"), rest)
        return self._view(ml.predict(self.spark.table(m[1]), model, [c.strip() for c in m[3].split(",")]))

    def _vectors(self, body: str) -> str:
        args = [a.strip() for a in split_top(body)]
        if len(args) < 5 or not (d := re.fullmatch(r"DESCRIPTOR\s*\(\s*(\w+)\s*\)", args[3], re.I)):
            raise Refused(f"VECTOR_SEARCH(TABLE t, column, corpus, DESCRIPTOR(v), k [, options]): {body}")
        named = {k.strip().lower(): v.strip().strip("'") for k, v in (a.split("=", 1) for a in args[5:])}
        pairs = [tuple(x.strip() for x in p.split(":")) for p in named.get("filter_eq", "").split(",") if p]
        queries, corpus = self.spark.table(re.sub(r"^TABLE\s+", "", args[0], flags=re.I)), self.spark.table(args[2])
        numbered = queries.withColumn("_query", F.monotonically_increasing_id())
        found = vector.search(numbered, "_query", args[1], corpus, corpus.columns[0], d[1], int(args[4]), named.get("metric", "cosine"), pairs)
        return self._view(found.drop("_query"))

    def _match(self, table: str, body: str) -> str:
        part = lambda name, stop: (m := re.search(rf"\b{name}\s+(.*?)\s*(?={stop}|$)", body, re.I | re.S)) and m[1].strip()
        stops = r"\b(?:PARTITION\s+BY|ORDER\s+BY|MEASURES|ONE\s+ROWS?\s+PER|ALL\s+ROWS\s+PER|AFTER\s+MATCH|PATTERN|DEFINE)\b"
        keys = [k.strip() for k in (part(r"PARTITION\s+BY", stops) or "").split(",") if k.strip()]
        order = part(r"ORDER\s+BY", stops)
        if not order or "," in order:
            raise Refused("MATCH_RECOGNIZE is ordered by one column")
        if (after := part(r"AFTER\s+MATCH", stops)) and not re.fullmatch(r"SKIP\s+PAST\s+LAST\s+ROW", after, re.I):
            raise Refused(f"AFTER MATCH {after} is not supported")
        pattern = re.search(r"\bPATTERN\s*\((.*?)\)\s*(?=DEFINE|$)", body, re.I | re.S)[1]
        rows = self.spark.table(table)
        order = order.split()[0]
        define, extra = {}, rows
        for item in split_top(part("DEFINE", r"\x02") or ""):
            name, test = re.match(r"\s*(\w+)\s+AS\s+(.*)$", item, re.I | re.S).groups()
            for column in set(re.findall(r"\bPREV\s*\(\s*(?:\w+\.)?(\w+)\s*\)", test, re.I)):
                extra = extra.withColumn(f"_prev_{column}", cep.prev(column, keys, order))
            test = re.sub(r"\bPREV\s*\(\s*(?:\w+\.)?(\w+)\s*\)", r"_prev_\1", test, flags=re.I)
            define[name] = F.expr(dialect.functions(re.sub(rf"\b{name}\.", "", test)))
        measures, fields = {}, [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
        for item in split_top(part("MEASURES", stops) or ""):
            if not item.strip():
                continue
            expression, name = re.match(r"\s*(.+?)\s+AS\s+(\w+)\s*$", item, re.I | re.S).groups()
            if re.match(r"CLASSIFIER\s*\(\s*\)", expression, re.I):
                measures[name], kind = ("CLASSIFIER", "", ""), "string"
            else:
                m = re.fullmatch(r"(FIRST|LAST)\s*\(\s*(?:(\w+)\.)?(\w+)\s*\)", expression, re.I)
                if not m:
                    raise Refused(f"measures are FIRST, LAST and CLASSIFIER(): {expression}")
                measures[name], kind = (m[1].upper(), m[2] or "", m[3]), rows.schema[m[3]].dataType.simpleString()
            fields.append(f"`{name}` {kind}")
        every = bool(re.search(r"\bALL\s+ROWS\s+PER\s+MATCH\b", body, re.I))
        if every:
            fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + fields[len(keys) :]
        return self._view(cep.match_recognize(extra, keys, order, pattern, define, measures, ", ".join(fields), every))


def _assignable(have: T.DataType, want: T.DataType) -> bool:
    whole = T.ByteType | T.ShortType | T.IntegerType | T.LongType
    real = T.DecimalType | T.FloatType | T.DoubleType
    return (isinstance(have, T.DecimalType) and isinstance(want, real)) or (isinstance(have, whole) and isinstance(want, real)) or isinstance(have, T.NullType)


class TableApi:
    """A fluent query over an engine's table: filter, select, group_by, aggregate, insert_into."""

    def __init__(self, engine: Engine, df: DataFrame):
        self.engine, self.df, self.keys = engine, df, []

    @staticmethod
    def from_table(engine: Engine, name: str) -> TableApi:
        return TableApi(engine, engine._table(name))

    def _with(self, df: DataFrame, keys: list[str] | None = None) -> TableApi:
        out = TableApi(self.engine, df)
        out.keys = keys or []
        return out

    def filter(self, test) -> TableApi:
        return self._with(self.df.filter(test))

    def select(self, *columns) -> TableApi:
        return self._with(self.df.select(*columns))

    def group_by(self, *keys: str) -> TableApi:
        return self._with(self.df, list(keys))

    def aggregate(self, *aggregates) -> TableApi:
        return self._with(self.df.groupBy(*self.keys).agg(*aggregates))

    def insert_into(self, name: str) -> Result:
        return self.engine._insert(f"INSERT INTO {name} SELECT * FROM {self.engine._view(self.df)}")
