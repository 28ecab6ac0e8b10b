"""A small SQL reader: tokens to a tree of queries and expressions.

It reads the query language that script corpora use, well enough to count and
resolve: WITH, SELECT, set operations, joins, subqueries, windows, grouping sets,
CASE.  A tree node is ``Node(kind, text, children)``; queries are ``Select`` and
``SetOp``.  It runs inside Arrow tasks, so a corpus is parsed in parallel.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<str>'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*")
      |(?P<qid>`[^`]+`|\[[A-Za-z_][^\]\n]*\])
      |(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
      |(?P<id>[^\W\d]\w*|\$\{?\w+\}?|:\w+|\#\w+)
      |(?P<op><=>|<>|!=|>=|<=|\|\||::|->|=>|==|[-+*/%(),.;=<>\[\]?&|^~:{}@])""",
    re.S | re.X,
)
_END_OF_ITEM = set("from where group having order limit union intersect except minus window qualify on using join inner left right full cross natural lateral fetch offset cluster distribute sort as when then else end and or not in is between like ilike rlike asc desc nulls rows range over filter within by set tablesample pivot unpivot semi anti".split())
_AGGREGATES = frozenset(
    "sum avg count min max stddev stddev_samp stddev_pop variance var_samp var_pop corr covar_pop covar_samp approx_count_distinct approx_distinct collect_list collect_set array_agg string_agg listagg group_concat any_value first last median mode percentile percentile_cont percentile_disc percentile_approx bool_and bool_or every count_if max_by min_by rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value grouping grouping_id".split()
)
_ALIAS_OF_FUNCTION = {"substr": "substring", "char_length": "length", "string_agg": "listagg", "group_concat": "listagg"}


class ParseError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    text: str = ""
    children: list = field(default_factory=list)

    def walk(self, into_queries: bool = False):
        """This node and what is below it, without the insides of subqueries unless asked for."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            for c in reversed(n.children):
                if isinstance(c, Node):
                    stack.append(c)
                elif into_queries:
                    stack.extend(reversed(list(c.expressions())))


@dataclass
class Source:
    name: str
    alias: str | None = None
    query: object = None
    condition: Node | None = None
    joined: str = ""  # "" for the first, "comma", "on", "using", "none"
    arguments: list = field(default_factory=list)


@dataclass
class Select:
    items: list[tuple[Node, str | None]] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    where: Node | None = None
    rest: list[Node] = field(default_factory=list)  # group keys, order keys, named windows, qualify, limit
    having: Node | None = None
    distinct: bool = False
    ordered: bool = False
    ctes: list[tuple[str, object]] = field(default_factory=list)

    def expressions(self):
        yield from (e for e, _ in self.items)
        for s in self.sources:
            yield from s.arguments
            if s.condition:
                yield s.condition
        yield from (e for e in (self.where, self.having) if e)
        yield from self.rest

    def outputs(self) -> list[str]:
        names = [alias or (e.text.rsplit(".", 1)[-1] if e.kind == "column" else "") for e, alias in self.items]
        return [n.lower() for n in names if n and n != "*"]


@dataclass
class SetOp:
    op: str
    everything: bool
    left: object = None
    right: object = None
    rest: list[Node] = field(default_factory=list)
    ordered: bool = False
    ctes: list[tuple[str, object]] = field(default_factory=list)

    def expressions(self):
        yield from self.rest

    def outputs(self) -> list[str]:
        return self.left.outputs()


def tokenize(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected {sql[at : at + 12]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class Parser:
    """One statement's tokens.  ``dialect`` decides what else than common SQL is read."""

    def __init__(self, tokens: list[tuple[str, str]], dialect: str = "spark"):
        self.tokens, self.at, self.dialect = tokens, 0, dialect

    # -- Tokens --------------------------------------------------------------

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][1].lower() if i < len(self.tokens) and self.tokens[i][0] in ("id", "op") else ""

    def kind(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else "end"

    def take(self, *words: str) -> bool:
        for i, w in enumerate(words):
            if self.peek(i) != w:
                return False
        self.at += len(words)
        return True

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ParseError(f"{word} expected, {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'} found")

    def name(self) -> str:
        kind = self.kind()
        if kind not in ("id", "qid") and not (kind == "str" and self.tokens[self.at][1][0] == '"'):
            raise ParseError(f"a name expected, {self.tokens[self.at][1] if kind != 'end' else 'the end'} found")
        if kind == "qid" and self.tokens[self.at][1][0] == "[" and self.dialect != "tsql":
            raise ParseError("bracketed name")
        text = self.tokens[self.at][1]
        self.at += 1
        return text.strip('`"[]')

    # -- Queries -------------------------------------------------------------

    def statement(self):
        query = self.query()
        if self.at < len(self.tokens):
            raise ParseError(f"unexpected {self.tokens[self.at][1]!r}")
        return query

    def query(self):
        ctes = []
        if self.take("with"):
            self.take("recursive")
            while True:
                name = self.name()
                if self.peek() == "(":
                    self.names()
                self.need("as")
                self.need("(")
                ctes.append((name, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        body = self.set_operations()
        rest, ordered = [], False
        while True:
            if self.take("order", "by") or self.take("sort", "by"):
                ordered = True
                rest += self.order_keys()
            elif self.take("cluster", "by") or self.take("distribute", "by"):
                rest += self.list_of(self.expression)
            elif self.take("limit"):
                rest.append(Node("literal", "all") if self.take("all") else self.expression())
            elif self.take("offset"):
                rest.append(self.expression())
                self.take("rows") or self.take("row")
            elif self.take("fetch"):
                self.at += 1
                rest.append(self.expression())
                self.take("rows") or self.take("row")
                self.need("only")
            else:
                break
        body.rest += rest
        body.ordered |= ordered
        body.ctes = ctes + body.ctes
        return body

    def set_operations(self):
        left = self.intersections()
        while self.peek() in ("union", "except", "minus"):
            op = self.peek()
            self.at += 1
            everything = self.take("all")
            self.take("distinct")
            left = SetOp("except" if op == "minus" else op, everything, left, self.intersections())
        return left

    def intersections(self):
        left = self.query_term()
        while self.take("intersect"):
            everything = self.take("all")
            self.take("distinct")
            left = SetOp("intersect", everything, left, self.query_term())
        return left

    def query_term(self):
        if self.take("("):
            inner = self.query()
            self.need(")")
            return inner
        if self.take("values"):
            return Select(items=[(Node("list", "", self.list_of(self.expression)), None)])
        self.need("select")
        s = Select()
        if self.peek() == "top" and (self.kind(1) == "num" or self.peek(1) == "("):
            if self.dialect != "tsql":
                raise ParseError("TOP")
            self.at += 1
            s.rest.append(self.primary())
        s.distinct = self.take("distinct")
        self.take("all")
        s.items = self.list_of(self.item)
        if self.take("from"):
            s.sources = self.sources()
        if self.take("where"):
            s.where = self.expression()
        if self.take("group", "by"):
            s.rest += self.list_of(self.group_key)
            self.take("with", "rollup") or self.take("with", "cube")
        if self.take("having"):
            s.having = self.expression()
        if self.take("window"):
            while True:
                self.name()
                self.need("as")
                s.rest.append(self.window_spec(s))
                if not self.take(","):
                    break
        if self.take("qualify"):
            s.rest.append(self.expression())
        return s

    def item(self) -> tuple[Node, str | None]:
        e = self.expression()
        if self.take("as"):
            return e, self.name() if self.kind() != "str" else self._string_name()
        if self.kind() in ("qid",) or self.kind() == "id" and self.peek() not in _END_OF_ITEM:
            return e, self.name()
        return e, None

    def _string_name(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1].strip("'\"")

    def group_key(self) -> Node:
        if self.take("grouping", "sets"):
            return Node("grouping_sets", "", self.parenthesised_list())
        return self.expression()

    def sources(self) -> list[Source]:
        found = self.source()
        while True:
            if self.take(","):
                more = self.source()
                more[0].joined = "comma"
                found += more
                continue
            at = self.at
            self.take("natural")
            for w in ("inner", "cross", "left", "right", "full", "asof"):
                if self.take(w):
                    break
            self.take("outer") or self.take("semi") or self.take("anti")
            if not self.take("join"):
                self.at = at
                return found
            more = self.source()
            more[0].joined = "none"
            if self.take("on"):
                more[0].condition, more[0].joined = self.expression(), "on"
            elif self.take("using"):
                self.names()
                more[0].joined = "using"
            found += more

    def source(self) -> list[Source]:
        self.take("lateral")
        if self.peek() == "(":
            at = self.at
            self.at += 1
            try:
                query = self.query()
                self.need(")")
            except ParseError:
                self.at = at + 1
                inner = self.sources()
                self.need(")")
                self.alias()
                return inner
            return [Source("", self.alias(), query)]
        if self.peek() in ("values", "select"):
            return [Source("", self.alias(), self.query_term())]
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        if self.peek() == "(":
            return [Source("", self.alias_after(self.parenthesised_list()), None, arguments=[])]
        if self.take("tablesample"):
            self.parenthesised_list()
        return [Source(parts[-1], self.alias())]

    def alias_after(self, _arguments: list) -> str | None:
        return self.alias()

    def alias(self) -> str | None:
        found = None
        if self.take("as") or self.kind() == "qid" or self.kind() == "id" and self.peek() not in _END_OF_ITEM:
            found = self.name()
            if self.peek() == "(":
                self.names()
        return found

    def names(self) -> list[str]:
        self.need("(")
        found = self.list_of(self.name)
        self.need(")")
        return found

    def list_of(self, item) -> list:
        found = [item()]
        while self.take(","):
            found.append(item())
        return found

    def parenthesised_list(self) -> list[Node]:
        self.need("(")
        found = [] if self.peek() == ")" else self.list_of(self.expression)
        self.need(")")
        return found

    def order_keys(self) -> list[Node]:
        found = []
        while True:
            found.append(self.expression())
            self.take("asc") or self.take("desc")
            if self.take("nulls"):
                self.at += 1
            if not self.take(","):
                return found

    # -- Expressions -----------------------------------------------------------

    def expression(self) -> Node:
        left = self.conjunction()
        while self.take("or"):
            left = Node("or", "", [left, self.conjunction()])
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.take("and"):
            left = Node("and", "", [left, self.negation()])
        return left

    def negation(self) -> Node:
        if self.take("not"):
            return Node("not", "", [self.negation()])
        return self.comparison()

    def comparison(self) -> Node:
        left = self.concatenation()
        while True:
            op = self.peek()
            if op in ("=", "==", "<>", "!=", "<", ">", "<=", ">=", "<=>"):
                self.at += 1
                if self.peek() in ("any", "all", "some"):
                    self.at += 1
                left = Node("eq" if op in ("=", "==") else "compare", op, [left, self.concatenation()])
            elif self.take("is"):
                self.take("not")
                if self.take("distinct", "from"):
                    left = Node("compare", "is", [left, self.concatenation()])
                else:
                    self.at += 1
                    left = Node("is", "", [left])
            elif op in ("not", "in", "between", "like", "ilike", "rlike", "regexp", "similar"):
                at = self.at
                self.take("not")
                if self.take("in"):
                    self.need("(")
                    if self.peek() in ("select", "with") or self.peek() == "(" and self.peek(1) in ("select", "with"):
                        inner = [self.query()]
                    else:
                        inner = self.list_of(self.expression)
                    self.need(")")
                    left = Node("in", "", [left, *inner])
                elif self.take("between"):
                    low = self.concatenation()
                    self.need("and")
                    left = Node("between", "", [left, low, self.concatenation()])
                elif self.peek() in ("like", "ilike", "rlike", "regexp", "similar"):
                    self.at += 1
                    self.take("to")
                    left = Node("like", "", [left, self.concatenation()])
                    if self.take("escape"):
                        self.at += 1
                else:
                    self.at = at
                    return left
            else:
                return left

    def concatenation(self) -> Node:
        left = self.product()
        while self.peek() in ("+", "-", "||", "&", "|", "^", "->"):
            op = self.peek()
            self.at += 1
            left = Node("binary", op, [left, self.product()])
        return left

    def product(self) -> Node:
        left = self.unary()
        while self.peek() in ("*", "/", "%", "div"):
            op = self.peek()
            self.at += 1
            left = Node("binary", op, [left, self.unary()])
        return left

    def unary(self) -> Node:
        if self.peek() in ("-", "+", "~"):
            self.at += 1
            return Node("unary", "", [self.unary()])
        e = self.primary()
        while True:
            if self.take("::"):
                self.type_name()
                e = Node("cast", "", [e])
            elif self.take("["):
                e = Node("index", "", [e, self.expression()])
                self.need("]")
            elif self.take("at", "time", "zone"):
                e = Node("binary", "zone", [e, self.primary()])
            else:
                return e

    def type_name(self) -> None:
        self.name()
        if self.take("precision") or self.take("varying"):
            pass
        if self.peek() == "(":
            self.parenthesised_list()
        elif self.take("<"):
            depth = 1
            while depth:
                depth += (self.peek() == "<") - (self.peek() == ">")
                self.at += 1
                if self.at > len(self.tokens):
                    raise ParseError("unclosed type")

    def primary(self) -> Node:
        kind, word = self.kind(), self.peek()
        if kind == "end":
            raise ParseError("unexpected end")
        if kind in ("num", "str"):
            text = self.tokens[self.at][1]
            self.at += 1
            return Node("literal", text)
        if word == "(":
            self.at += 1
            if self.peek() in ("select", "with"):
                e = Node("subquery", "", [self.query()])
            elif self.peek() == "(" and self._query_ahead():
                e = Node("subquery", "", [self.query()])
            else:
                inner = self.list_of(self.expression)
                e = inner[0] if len(inner) == 1 else Node("list", "", inner)
            self.need(")")
            return e
        if word in ("*", "?"):
            self.at += 1
            return Node("star", word)
        if word == "case":
            return self.case()
        if word == "exists" and self.peek(1) == "(":
            self.at += 2
            e = Node("subquery", "exists", [self.query()])
            self.need(")")
            return e
        if word == "interval":
            self.at += 1
            value = self.unary() if self.kind() in ("num", "str") or self.peek() in ("-", "+", "(") else self.primary()
            while self.kind() == "id" and re.fullmatch("(year|quarter|month|week|day|hour|minute|second)s?", self.peek()):
                self.at += 1
            return Node("interval", "", [value])
        if word in ("date", "timestamp", "time", "timestamp_ntz") and self.kind(1) == "str":
            self.at += 2
            return Node("literal", word)
        if word in ("cast", "try_cast", "convert") and self.peek(1) == "(":
            self.at += 2
            e = Node("cast", "", [self.expression()])
            if self.take("as"):
                self.type_name()
            elif self.take(","):
                e.children.append(self.expression())
            self.need(")")
            return e
        if word in ("null", "true", "false", "current_date", "current_timestamp") and self.peek(1) != "(":
            self.at += 1
            return Node("literal", word)
        if kind == "op":
            raise ParseError(f"unexpected {word!r}")
        if word in _END_OF_ITEM and word not in ("left", "right", "set", "range", "rows", "filter", "offset", "sort") and self.peek(1) != "(":
            raise ParseError(f"unexpected {word!r}")
        parts = [self.name()]
        while self.peek() == "." and (self.kind(1) in ("id", "qid", "str") or self.peek(1) == "*"):
            self.at += 1
            if self.take("*"):
                return Node("star", ".".join(parts))
            parts.append(self.name())
        if self.peek() == "(" and kind == "id":
            return self.call(parts[-1].lower())
        return Node("column", ".".join(parts))

    def _query_ahead(self) -> bool:
        i = 0
        while self.peek(i) == "(":
            i += 1
        return self.peek(i) in ("select", "with")

    def case(self) -> Node:
        self.need("case")
        parts = [] if self.peek() == "when" else [self.expression()]
        branches = 0
        while self.take("when"):
            parts.append(self.expression())
            self.need("then")
            parts.append(self.expression())
            branches += 1
        if self.take("else"):
            parts.append(self.expression())
        self.need("end")
        return Node("case", str(branches), parts)

    def call(self, name: str) -> Node:
        start = self.at - 1
        self.need("(")
        args: list = []
        distinct = self.take("distinct")
        self.take("all")
        if self.peek() != ")":
            if self.peek() in ("select", "with"):
                args.append(self.query())
            else:
                args.append(self.argument())
            while self.take(",") or self.take("from") or self.take("for") or self.take("in"):
                args.append(self.argument())
            if self.take("order", "by"):
                args.append(Node("order", "", self.order_keys()))
        self.need(")")
        call = Node("distinct_call" if distinct else "call", _ALIAS_OF_FUNCTION.get(name, name), args)
        if self.take("within", "group"):
            self.need("(")
            self.need("order")
            self.need("by")
            call.children.append(Node("order", "", self.order_keys()))
            self.need(")")
        if self.take("filter"):
            self.need("(")
            self.need("where")
            call.children.append(self.expression())
            self.need(")")
        self.take("ignore", "nulls") or self.take("respect", "nulls")
        if self.take("over"):
            spec = self.window_spec() if self.peek() == "(" else Node("spec", self.name())
            text = " ".join(t.lower() if k in ("id", "op") else t for k, t in self.tokens[start : self.at])
            return Node("window", text, [call, spec])
        return call

    def argument(self) -> Node:
        e = self.expression()
        if self.take("as"):  # named or typed arguments
            self.type_name()
        return e

    def window_spec(self, _owner: Select | None = None) -> Node:
        self.need("(")
        parts = []
        if self.kind() == "id" and self.peek() not in ("partition", "order", "rows", "range", "groups", "cluster", "distribute", "sort"):
            self.name()
        if self.take("partition", "by") or self.take("distribute", "by") or self.take("cluster", "by"):
            parts += self.list_of(self.expression)
        if self.take("order", "by") or self.take("sort", "by"):
            parts.append(Node("order", "", self.order_keys()))
        if self.peek() in ("rows", "range", "groups"):
            depth = 0
            while depth or self.peek() != ")":
                depth += (self.peek() == "(") - (self.peek() == ")")
                self.at += 1
                if self.at >= len(self.tokens):
                    raise ParseError("unclosed window")
        self.need(")")
        return Node("spec", "", parts)


def split_statements(tokens: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out: list[list[tuple[str, str]]] = [[]]
    for t in tokens:
        if t == ("op", ";"):
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


#: The dialects that are tried, in order.
DIALECTS = ("spark", "tsql", "presto", "duckdb")


def parse(sql: str) -> tuple[list, str, str]:
    """(queries, dialect, error): by the first dialect that reads all statements; without one no queries and the first error."""
    error = ""
    for dialect in DIALECTS:
        try:
            parts = split_statements(tokenize(sql))
            if not parts:
                raise ParseError("no statement")
            return [Parser(p, dialect).statement() for p in parts], dialect, ""
        except (ParseError, RecursionError, IndexError) as e:
            error = error or str(e).splitlines()[0]
    return [], "", error


def is_aggregate(name: str) -> bool:
    return name in _AGGREGATES
