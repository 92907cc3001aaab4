"""Lexer, syntax tree and parser of the read-only Cypher subset.

Beyond the plain grammar it takes ``[r:TYPE]``, unary minus, ``-->``, ``<--`` and ``--`` between nodes, and several
labels, types and far-node filters inside ``EXISTS``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_DEPTH = 10


class CypherError(ValueError):
    """The text is no query of the subset, or one that cannot be planned."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} at position {position}")
        self.position = position


KEYWORDS = set(
    """MATCH OPTIONAL WHERE RETURN DISTINCT ORDER BY ASC DESC SKIP LIMIT UNION ALL AS AND OR XOR NOT IN IS NULL EXISTS
    CONTAINS STARTS ENDS WITH TRUE FALSE COUNT SUM AVG MIN MAX COLLECT UNWIND CASE WHEN THEN ELSE END
    CREATE DELETE DETACH SET REMOVE MERGE YIELD CALL FOREACH MANDATORY DROP CONSTRAINT ON FOR OF GRAPH""".split()
)
WRITES = {"CREATE", "DELETE", "DETACH", "SET", "REMOVE", "MERGE", "YIELD", "CALL", "FOREACH", "MANDATORY", "DROP", "CONSTRAINT"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT")
SCALAR_FUNCTIONS = {"tolower": "toLower", "toupper": "toUpper", "tostring": "toString"}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<str>'(?:\\.|[^'\\])*(?:'|$)|"(?:\\.|[^"\\])*(?:"|$))
    |(?P<num>\d+(?:\.(?!\.)\d+)?|\.\d+)
    |(?P<id>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>=~|<>|!=|<=|>=|\.\.|[-<>=()\[\]{}:,.|*])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Token:
    kind: str  # str, num, id, kw, op, end
    text: str
    at: int


def lex(text: str) -> list[Token]:
    """Tokens of a query. ``--`` starts a comment unless it stands where a relationship can."""
    out: list[Token] = []
    i = 0
    while i < len(text):
        if text.startswith("--", i) and not (out and out[-1].text in (")", "<") and re.match(r"--\s*>?\s*\(", text[i:])):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            continue
        m = _TOKEN.match(text, i)
        if not m:
            i += 1  # unknown characters are skipped
            continue
        kind, word = m.lastgroup, m.group()
        if kind == "str":
            quote = word[0]
            body = word[1:-1] if len(word) > 1 and word.endswith(quote) else word[1:]
            out.append(Token("str", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), body, flags=re.S), i))
        elif kind == "id":
            out.append(Token("kw" if word.upper() in KEYWORDS else "id", word, i))
        elif kind != "skip":
            out.append(Token(kind, word, i))
        i = m.end()
    out.append(Token("end", "", len(text)))
    return out


# --------------------------------------------------------------------------------------------------- tree


@dataclass
class NodeP:
    var: str
    labels: list[str] = field(default_factory=list)
    props: dict[str, object] = field(default_factory=dict)
    named: bool = True


@dataclass
class RelP:
    types: list[str]
    direction: str  # out, in, any
    low: int = 1
    high: int = 1

    @property
    def variable(self) -> bool:
        return (self.low, self.high) != (1, 1)


@dataclass
class Pattern:
    nodes: list[NodeP]
    rels: list[RelP]


@dataclass
class Prop:
    var: str
    key: str | None  # None: the node itself


@dataclass
class Cond:
    op: str  # = <> < <= > >= =~ contains starts ends in isnull label exists and or xor not
    left: object = None
    right: object = None


@dataclass
class Item:
    kind: str  # prop, agg, func, star
    prop: Prop | None = None
    fn: str = ""
    distinct: bool = False
    alias: str = ""


@dataclass
class Key:
    item: Item | None  # None: by alias
    alias: str
    desc: bool


@dataclass
class Query:
    patterns: list[Pattern]
    where: Cond | None = None
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    order: list[Key] = field(default_factory=list)
    skip: int = 0
    limit: int = 0
    union: Query | None = None
    union_all: bool = False


# ------------------------------------------------------------------------------------------------- parser


class Parser:
    def __init__(self, text: str):
        self.tokens, self.i, self.anonymous = lex(text), 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, what: str):
        raise CypherError(f"expected {what}, found {self.now.text or 'the end'!r}", self.now.at)

    def peek(self, *texts: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return (t.kind == "op" and t.text in texts) or (t.kind == "kw" and t.text.upper() in texts)

    def take(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.i += 1
            return self.tokens[self.i - 1].text
        return None

    def need(self, *texts: str) -> str:
        return self.take(*texts) or self.fail(" or ".join(texts))

    def ident(self) -> str:
        if self.now.kind != "id":
            self.fail("a name")
        self.i += 1
        return self.tokens[self.i - 1].text

    def word(self) -> str:
        """A name where keywords are names too: labels, types and property keys."""
        if self.now.kind not in ("id", "kw"):
            self.fail("a name")
        self.i += 1
        return self.tokens[self.i - 1].text

    def integer(self) -> int:
        if self.now.kind != "num" or not self.now.text.isdigit():
            self.fail("a whole number")
        self.i += 1
        return int(self.tokens[self.i - 1].text)

    def query(self) -> Query:
        for before, t in zip([None, *self.tokens], self.tokens):
            named = before is not None and before.text in (":", ".", "|", "{", ",")
            if t.kind == "kw" and t.text.upper() in WRITES and not named:
                raise CypherError(f"{t.text.upper()} is not supported: queries only read", t.at)
        out = self.single()
        if self.now.kind != "end":
            self.fail("the end of the query")
        return out

    def single(self) -> Query:
        if self.peek("OPTIONAL"):
            raise CypherError("OPTIONAL MATCH is not supported", self.now.at)
        self.need("MATCH")
        q = Query([self.pattern()])
        while True:
            if self.peek("OPTIONAL"):
                raise CypherError("OPTIONAL MATCH is not supported", self.now.at)
            if not self.take("MATCH"):
                break
            q.patterns.append(self.pattern())
        if self.take("WHERE"):
            q.where = self.disjunction()
        if self.take("RETURN"):
            self.returns(q)
        if self.take("UNION"):
            q.union_all = bool(self.take("ALL"))
            q.union = self.single()
        return q

    def pattern(self) -> Pattern:
        p = Pattern([self.node()], [])
        while self.peek("-", "<"):
            p.rels.append(self.rel())
            p.nodes.append(self.node())
        return p

    def node(self) -> NodeP:
        self.need("(")
        named = self.now.kind == "id"
        if named:
            var = self.ident()
        else:
            self.anonymous += 1
            var = f"_a{self.anonymous}"
        out = NodeP(var, named=named)
        if self.take(":"):
            out.labels.append(self.word())
            while self.take("|"):
                out.labels.append(self.word())
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                out.props[key] = self.literal()
                self.take(",")
        self.need(")")
        return out

    def rel(self) -> RelP:
        left = bool(self.take("<"))
        self.need("-")
        out = RelP([], "any")
        if self.take("["):
            if self.now.kind == "id":
                self.ident()
            if self.take(":"):
                out.types.append(self.word())
                while self.take("|"):
                    self.take(":")
                    out.types.append(self.word())
            if self.take("*"):
                self.span(out)
            self.need("]")
        self.need("-")
        right = bool(self.take(">"))
        out.direction = "any" if left == right else "in" if left else "out"
        return out

    def span(self, rel: RelP) -> None:
        """``*`` is 1 to 10, ``*n`` is 1 to n (``*0`` leaves the end open), ``*m..n`` as written."""
        at = self.now.at
        low, high = 1, MAX_DEPTH
        if self.now.kind == "num":
            n = self.integer()
            if self.take(".."):
                low, high = n, self.integer() if self.now.kind == "num" else MAX_DEPTH
            else:
                high = n or MAX_DEPTH
        elif self.take(".."):
            high = self.integer() if self.now.kind == "num" else MAX_DEPTH
        if high > MAX_DEPTH:
            raise CypherError(f"paths longer than {MAX_DEPTH} are not supported", at)
        if low > high:
            raise CypherError("the path's lower bound is above its upper bound", at)
        rel.low, rel.high = low, high

    def literal(self):
        t = self.now
        if t.kind == "str":
            self.i += 1
            return t.text
        if t.kind == "num" or self.peek("-"):
            sign = -1 if self.take("-") else 1
            if self.now.kind != "num":
                self.fail("a number")
            text = self.now.text
            self.i += 1
            return sign * (float(text) if "." in text else int(text))
        if self.take("TRUE"):
            return True
        if self.take("FALSE"):
            return False
        return self.fail("a literal")

    def chain(self, op: str, word: str, below) -> Cond:
        out = below()
        while self.take(word):
            out = Cond(op, out, below())
        return out

    def disjunction(self) -> Cond:
        return self.chain("or", "OR", lambda: self.chain("xor", "XOR", lambda: self.chain("and", "AND", self.negation)))

    def negation(self) -> Cond:
        if self.take("NOT"):
            return Cond("not", self.negation())
        if self.take("("):
            out = self.disjunction()
            self.need(")")
            return out
        return self.condition()

    def prop(self) -> Prop:
        var = self.ident()
        return Prop(var, self.word() if self.take(".") else None)

    def condition(self) -> Cond:
        if self.take("EXISTS"):
            self.need("{")
            self.take("MATCH")
            p = self.pattern()
            if len(p.rels) != 1 or p.rels[0].variable:
                raise CypherError("EXISTS takes a single hop", self.now.at)
            self.need("}")
            return Cond("exists", p)
        left = self.prop()
        if left.key is None and self.take(":"):
            return Cond("label", left, self.word())
        if self.take("IS"):
            negated = bool(self.take("NOT"))
            self.need("NULL")
            out = Cond("isnull", left)
            return Cond("not", out) if negated else out
        if self.take("IN"):
            self.need("[")
            values = []
            while not self.take("]"):
                values.append(self.literal())
                self.take(",")
            return Cond("in", left, values)
        negated = bool(self.take("NOT"))
        if self.take("CONTAINS"):
            op = "contains"
        elif self.take("STARTS"):
            self.need("WITH")
            op = "starts"
        elif self.take("ENDS"):
            self.need("WITH")
            op = "ends"
        elif negated:
            return self.fail("CONTAINS, STARTS WITH or ENDS WITH")
        else:
            op = self.need("=", "<>", "!=", "<", "<=", ">", ">=", "=~").replace("!=", "<>")
        out = Cond(op, left, self.literal())
        return Cond("not", out) if negated else out

    def item(self) -> Item:
        t = self.now
        if t.kind == "kw" and t.text.upper() in AGGREGATES:
            self.i += 1
            self.need("(")
            out = Item("agg", fn=t.text.upper(), distinct=bool(self.take("DISTINCT")))
            if not self.take("*"):
                out.prop = self.prop()
            elif out.fn != "COUNT" or out.distinct:
                raise CypherError(f"{out.fn}(*) is not supported", t.at)
            self.need(")")
            out.alias = out.fn.lower()
        elif t.kind == "id" and self.peek("(", ahead=1):
            if t.text.lower() not in SCALAR_FUNCTIONS:
                raise CypherError(f"the function {t.text} is not supported", t.at)
            self.i += 2
            out = Item("func", self.prop(), fn=SCALAR_FUNCTIONS[t.text.lower()])
            self.need(")")
            out.alias = out.fn.lower()
        else:
            out = Item("prop", self.prop())
            if self.peek("["):
                raise CypherError("indexing is not supported", self.now.at)
            out.alias = out.prop.var + (f"_{out.prop.key}" if out.prop.key else "")
        return out

    def returns(self, q: Query) -> None:
        q.distinct = bool(self.take("DISTINCT"))
        if self.take("*"):
            q.items.append(Item("star"))
        else:
            while True:
                item = self.item()
                if self.take("AS"):
                    item.alias = self.ident()
                q.items.append(item)
                if not self.take(","):
                    break
        if self.take("ORDER"):
            self.need("BY")
            while True:
                plain = self.now.kind == "id" and not self.peek(".", "(", ahead=1)
                name = self.now.text
                item = self.item()
                q.order.append(Key(item, name if plain else "", bool(self.take("DESC")) or bool(self.take("ASC") and False)))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            q.skip = self.integer()
        if self.take("LIMIT"):
            q.limit = self.integer()


def parse(text: str) -> Query:
    return Parser(text).query()
