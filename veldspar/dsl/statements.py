"""The statement level of the grammar: one Statement per text."""

from __future__ import annotations

from typing import Any

from .lexer import ParseError
from .parser import STAR, Item, Parser, Select, Statement


def parse(source: str) -> Statement:
    p = StatementParser(source)
    s = p.statement()
    p.skip(";")
    if p.peek():
        raise p.fail("the end")
    return s


class StatementParser(Parser):
    def statement(self) -> Statement:
        first = self.text()
        if first in ("SELECT", "WITH"):
            return Statement("select", {"select": self.select_statement()})
        handler = getattr(self, f"s_{first.lower()}", None) if first and first.isupper() else None
        if handler:
            self.at += 1
            return handler()
        return self.method_call()

    def made(self, kind: str, **args: Any) -> Statement:
        return Statement(kind, args)

    # --- tensors ---

    def s_vector(self) -> Statement:
        name = self.word()
        self.need("=")
        return self.made("tensor", name=name, values=self.bracketed()[1], strict=False, shape=None)

    s_matrix = s_vector

    def s_define(self) -> Statement:
        if self.skip("PIPELINE"):
            name = self.word()
            self.need("AS")
            return self.made("define_pipeline", name=name, steps=self.pipeline_steps(), source=self.written.strip())
        name = self.word()
        self.need("AS")
        strict = self.skip("STRICT")
        self.need("TENSOR", "[")
        shape = self.listed(self.whole, "]")
        self.need("VALUES", "[")
        return self.made("tensor", name=name, values=self.listed(self.number, "]"), strict=strict, shape=shape)

    def s_let(self) -> Statement:
        lazy = self.skip("LAZY")
        name = self.word()
        self.need("=")
        return self.made("let", name=name, lazy=lazy, expr=self.tensor())

    def s_lazy(self) -> Statement:
        self.need("LET")
        name = self.word()
        self.need("=")
        return self.made("let", name=name, lazy=True, expr=self.tensor())

    def s_derive(self) -> Statement:
        name = self.word()
        self.need("FROM")
        return self.made("let", name=name, lazy=False, expr=self.tensor())

    def s_bind(self) -> Statement:
        name = self.word()
        self.need("TO")
        return self.made("bind", name=name, target=self.word())

    def s_attach(self) -> Statement:
        tensor = self.word()
        self.need("TO")
        ds = self.word()
        self.need(".")
        return self.made("attach", tensor=tensor, dataset=ds, column=self.word())

    def method_call(self) -> Statement:
        ds = self.word()
        self.need(".", "add_column", "(")
        column = self.name()
        self.need(",")
        tensor = self.word()
        self.need(")")
        return self.made("attach", tensor=tensor, dataset=ds, column=column)

    # --- datasets ---

    def column_definition(self) -> dict:
        name = self.word()
        self.need(":")
        kind, dims = self.type_name()
        nullable, default = False, None
        while True:
            if self.skip("?") or self.skip("NULLABLE"):
                nullable = True
            elif self.skip("NOT", "NULLABLE"):
                nullable = False
            elif self.skip("DEFAULT"):
                default = self.expr()
            else:
                return {"name": name, "type": kind, "dims": dims, "nullable": nullable, "default": default}

    def s_dataset(self) -> Statement:
        name = self.word()
        if self.skip("FROM"):
            source, alias = self.source()
            s = Select([Item(STAR)], source, alias)
            self.clauses(s, with_select=True)
            return self.made("create_from", name=name, select=s)
        if self.skip("ADD", "COLUMN"):
            return self.added_column(name)
        self.need("COLUMNS")
        if self.skip("("):
            columns = self.listed(self.column_definition, ")")
        else:
            columns = self.listed(self.column_definition)
        return self.made("create_dataset", name=name, columns=columns)

    def added_column(self, dataset: str) -> Statement:
        if self.text(1) == "=":
            name = self.word()
            self.need("=")
            e = self.expr()
            return self.made("add_computed", dataset=dataset, name=name, expr=e, lazy=self.skip("LAZY"))
        return self.made("add_column", dataset=dataset, column=self.column_definition())

    def s_alter(self) -> Statement:
        self.need("DATASET")
        name = self.word()
        self.need("ADD", "COLUMN")
        return self.added_column(name)

    def s_materialize(self) -> Statement:
        name = self.word()
        if self.skip("."):
            self.word()
        return self.made("materialize", dataset=name)

    def s_insert(self) -> Statement:
        self.need("INTO")
        ds = self.word()
        if self.skip("VALUES"):
            self.need("(")
            return self.made("insert", dataset=ds, values=self.listed(self.expr, ")"), named=None)
        self.need("(")
        return self.made("insert", dataset=ds, values=None, named=dict(self.listed(self.assignment, ")")))

    def assignment(self) -> tuple[str, tuple]:
        name = self.word()
        self.need("=")
        return name, self.sum()

    def s_update(self) -> Statement:
        ds = self.word()
        self.need("SET")

        def one() -> tuple[str, tuple]:
            name = self.word()
            self.need("=")
            return name, self.expr()

        return self.made("update", dataset=ds, sets=self.listed(one), where=self.expr() if self.any_of("WHERE", "FILTER") else None)

    def s_delete(self) -> Statement:
        self.need("FROM")
        return self.made("delete", dataset=self.word(), where=self.expr() if self.any_of("WHERE", "FILTER") else None)

    def s_set(self) -> Statement:
        self.need("DATASET")
        ds = self.word()
        self.skip("METADATA")
        key = self.name()
        self.need("=")
        return self.made("set_metadata", dataset=ds, key=key, value=self.name())

    def s_transform(self) -> Statement:
        source = self.word()
        self.need("SELECT")
        s = Select([], source, distinct=self.skip("DISTINCT"))
        s.items = self.items()
        self.clauses(s)
        return self.made("transform", source=source, select=s, into=self.word() if self.skip("INTO") else None)

    # --- search and indexes ---

    def s_create(self) -> Statement:
        if self.skip("DATABASE"):
            quiet = self.skip("IF", "NOT", "EXISTS")
            return self.made("create_database", name=self.word(), quiet=quiet)
        vector = self.skip("VECTOR")
        self.need("INDEX")
        name = None if self.text() == "ON" else self.word()
        self.need("ON")
        ds = self.word()
        self.need("(")
        column = self.word()
        self.need(")")
        return self.made("create_index", dataset=ds, column=column, vector=vector, name=name)

    def query_vector(self) -> tuple:
        return self.bracketed() if self.text() == "[" else ("name", self.word())

    def s_search(self) -> Statement:
        name = self.word()
        if self.skip("FROM"):
            ds = self.word()
            self.need("QUERY")
            q = self.query_vector()
            self.need("ON")
            column = self.word()
            self.need("K", "=")
            return self.made("search", dataset=ds, column=column, query=q, k=self.whole(), into=name)
        if self.any_of("WHERE", "FILTER"):
            column = self.word()
            self.need("~=")
            q = self.query_vector()
        else:
            self.need("ON")
            column = self.word()
            self.need("QUERY")
            q = self.query_vector()
        self.need("LIMIT")
        k = self.whole()
        return self.made("search", dataset=name, column=column, query=q, k=k, into=self.word() if self.skip("INTO") else None)

    # --- persistence ---

    def path(self) -> str:
        return self.name()

    def fields(self) -> list[str] | None:
        if not self.skip("FIELDS"):
            return None
        self.need("(")
        return self.listed(self.name, ")")

    def s_use(self) -> Statement:
        if self.skip("DATABASE"):
            return self.made("use_database", name=self.word())
        if self.skip("DATASET"):
            self.need("FROM")
            path = self.path()
            return self.made("use_dataset", path=path, name=self.word() if self.skip("AS") else None, fields=self.fields())
        return self.made("use_database", name=self.word())

    def s_import(self) -> Statement:
        csv = not self.skip("DATASET")
        if csv:
            self.need("CSV")
        self.need("FROM")
        path = self.path()
        name = self.word() if self.skip("AS") else None
        return self.made("import_csv", path=path, name=name) if csv else self.made("import_dataset", path=path, name=name, fields=self.fields())

    def s_export(self) -> Statement:
        self.skip("CSV")
        name = self.word()
        self.need("TO")
        return self.made("export", name=name, path=self.path())

    def s_save(self) -> Statement:
        kind = self.any_of("DATASET", "TENSOR", "PIPELINE")
        if not kind:
            raise self.fail("DATASET, TENSOR or PIPELINE")
        return self.made(f"save_{kind.lower()}", name=self.word(), path=self.path() if self.skip("TO") else None)

    def s_load(self) -> Statement:
        kind = self.any_of("DATASET", "TENSOR", "PIPELINE")
        if not kind:
            raise self.fail("DATASET, TENSOR or PIPELINE")
        return self.made(f"load_{kind.lower()}", name=self.word(), path=self.path() if self.skip("FROM") else None)

    def s_list(self) -> Statement:
        if self.skip("DATASET", "VERSIONS"):
            return self.made("versions", name=self.word())
        if self.skip("DATASET", "PACKAGES"):
            return self.made("list", what="DATASETS", path=None)
        what = self.any_of("DATASETS", "TENSORS", "PIPELINES")
        if not what:
            raise self.fail("DATASETS, TENSORS or PIPELINES")
        return self.made("list", what=what, path=self.path() if self.skip("FROM") else None)

    def s_deliver(self) -> Statement:
        return self.made("deliver", name=self.word(), path=self.path() if self.skip("TO") else None)

    # --- pipelines ---

    def pipeline_steps(self) -> list[tuple[str, Any]]:
        def step() -> tuple[str, Any]:
            if self.skip("SELECT"):
                return "select", self.items()
            if self.any_of("WHERE", "FILTER"):
                return "where", self.expr()
            if self.skip("ORDER", "BY"):
                return "order", self.listed(self.order_key)
            if self.skip("LIMIT"):
                return "limit", self.whole()
            if self.skip("NORMALIZE"):
                return "normalize", self.word()
            raise self.fail("a pipeline step")

        out = [step()]
        while self.skip("THEN"):
            out.append(step())
        return out

    def s_apply(self) -> Statement:
        self.need("PIPELINE")
        name = self.word()
        self.need("ON")
        return self.made("apply_pipeline", name=name, dataset=self.word(), into=self.word() if self.skip("INTO") else None)

    def s_describe(self) -> Statement:
        self.need("PIPELINE")
        return self.made("describe_pipeline", name=self.word())

    def s_drop(self) -> Statement:
        if self.skip("PIPELINE"):
            return self.made("drop_pipeline", name=self.word())
        self.need("DATABASE")
        quiet = self.skip("IF", "EXISTS")
        return self.made("drop_database", name=self.word(), quiet=quiet)

    # --- introspection ---

    def s_show(self) -> Statement:
        if (t := self.peek()) and t.kind == "string":
            return self.made("say", text=self.string())
        if self.skip("ALL", "DATASETS"):
            return self.made("show_all", what="datasets")
        if self.skip("ALL", "DATABASES") or self.skip("DATABASES"):
            return self.made("show_all", what="databases")
        if self.skip("ALL"):
            self.skip("TENSORS")
            return self.made("show_all", what="tensors")
        if self.skip("PIPELINES"):
            return self.made("show_all", what="pipelines")
        for word in ("SCHEMA", "SHAPE", "LINEAGE"):
            if self.text() == word and self.peek(1):
                self.at += 1
                return self.made(f"show_{word.lower()}", name=self.word())
        if self.skip("INDEXES"):
            return self.made("show_indexes", dataset=self.word() if self.peek() and self.peek().kind == "word" else None)
        if self.skip("DATASET", "METADATA"):
            return self.made("show_metadata", name=self.word())
        if self.skip("DATASET", "VERSIONS"):
            return self.made("versions", name=self.word())
        name = self.word()
        if self.skip("."):
            return self.made("show_expr", expr=("field", name, self.word()))
        return self.made("show", name=name)

    def s_explain(self) -> Statement:
        self.skip("PLAN")
        if self.text() in ("SELECT", "WITH"):
            return self.made("explain", select=self.select_statement(), search=None)
        if self.skip("SEARCH"):
            return self.made("explain", select=None, search=self.s_search())
        self.skip("DATASET")
        name = self.word()
        if self.skip("FROM"):
            source, alias = self.source()
            s = Select([Item(STAR)], source, alias)
            self.clauses(s, with_select=True)
            return self.made("explain", select=s, search=None)
        return self.made("explain", select=Select([Item(STAR)], name), search=None)

    def s_audit(self) -> Statement:
        self.skip("DATASET")
        return self.made("audit", name=self.word())

    def s_reset(self) -> Statement:
        self.skip("SESSION")
        return self.made("reset")


__all__ = ["ParseError", "parse", "Statement"]
