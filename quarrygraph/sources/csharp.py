"""A lexical extractor of C# declarations, metrics and relationships.

There is no compiler here: declarations, bodies and calls are read from the token stream of each file, and names are
resolved by joins over what all files declare. Overloads share a name with their parameter lists; a call goes to a
declaration of its name and argument count where there is one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import file_qualified_name
from ..schema import FACTS, Graph
from ..session import by_value
from ..operators.store import resolve_edges, with_ids
from ..operators.traverse import transitive_depth

_TOKENS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|\#[^\n]*)|(?P<str>\$?@?"(?:\\.|""|[^"\\])*"|'(?:\\.|[^'\\])+')|(?P<num>\d[\w.]*)
    |(?P<id>@?[A-Za-z_]\w*)|(?P<op>=>|&&|\|\||\?\?=?|\?\.|[-+*/%&|^]=|==|!=|<=|>=|\+\+|--|::|[{}()\[\];,.<>=?:!&|+\-*/%^~@])""",
    re.X | re.S,
)
_TYPES = {"class": "Class", "struct": "Struct", "record": "Record", "interface": "Interface", "enum": "Enum"}
_MODIFIERS = set("public private protected internal static readonly abstract sealed virtual override async partial extern unsafe new const volatile ref required file".split())
_LOOPS = {"for", "foreach", "while", "do"}
_NOT_CALLS = set("if for foreach while switch catch using lock return throw nameof typeof sizeof default when fixed await new base this checked unchecked in is as and or not out ref".split())
_TESTS = {"Fact", "Theory", "Test", "TestMethod", "TestCase"}
_SCANS = set("Contains IndexOf Find FirstOrDefault First Any Where Count Single SingleOrDefault".split())


@dataclass
class Token:
    kind: str
    text: str
    line: int


def lex(text: str) -> list[Token]:
    out, line, i = [], 1, 0
    while i < len(text):
        m = _TOKENS.match(text, i)
        if not m:
            i += 1
            continue
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), line))
        line += m.group().count("\n")
        i = m.end()
    return out


@dataclass
class Decl:
    label: str
    name: str
    qn: str
    parent: str
    start: int
    end: int
    props: dict = field(default_factory=dict)
    bases: list[str] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    uses: list[tuple[str, str]] = field(default_factory=list)
    overrides: bool = False


def body_metrics(tokens: list[Token], name: str) -> tuple[dict, list[dict], list[tuple[str, str]]]:
    """Metrics of a body, its calls (name, arguments, loop and branch depth) and its other names (usage, writes)."""
    m = dict(complexity=1, cognitive=0, loop_count=0, loop_depth=0, max_access_depth=0, linear_scan_in_loop=0, alloc_in_loop=0, recursion_in_loop=False, unguarded_recursion=False, self_recursive=False)
    calls, uses = [], []
    stack: list[str] = []  # one entry per open block or pending statement: loop, branch, if, plain
    pending: str | None = None
    inline: list[tuple[str, int]] = []  # statements without braces end at their semicolon
    depth = 0
    i = 0
    loops = lambda: sum(x == "loop" for x in stack) + sum(k == "loop" for k, _ in inline)
    branches = lambda: sum(x in ("if", "branch") for x in stack) + sum(k in ("if", "branch") for k, _ in inline)
    guarded = lambda: "if" in stack or any(k == "if" for k, _ in inline)
    while i < len(tokens):
        t = tokens[i]
        nxt = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if t.text in ("(", "["):
            depth += 1
        elif t.text in (")", "]"):
            depth -= 1
            if depth == 0 and pending and nxt != "{":
                inline.append((pending, len(stack)))
                pending = None
        elif t.text == "{":
            stack.append(pending or "plain")
            pending = None
        elif t.text == "}":
            if stack:
                stack.pop()
            inline = [x for x in inline if x[1] < len(stack)]
        elif t.text == ";" and depth == 0:
            inline = [x for x in inline if x[1] < len(stack)]
        elif t.text in ("&&", "||"):
            m["complexity"] += 1
            m["cognitive"] += 1
        elif t.text == "?" and nxt not in (".", "[", ")", ",", ">", ";", "="):
            m["complexity"] += 1
            m["cognitive"] += 1 + branches()
        elif t.kind == "id":
            if t.text in _LOOPS and not (t.text == "while" and i and tokens[i - 1].text == "}"):
                m["complexity"] += 1
                m["cognitive"] += 1 + branches() + loops()
                m["loop_count"] += 1
                m["loop_depth"] = max(m["loop_depth"], loops() + 1)
                pending = "loop"
                if t.text == "do" and nxt == "{":
                    pass
            elif t.text in ("if", "catch"):
                m["complexity"] += 1
                m["cognitive"] += 1 + branches()
                pending = "if" if t.text == "if" else "branch"
            elif t.text in ("case", "default") and nxt not in ("(", ",", ")", ";"):
                m["complexity"] += 1
                m["cognitive"] += 1 + branches()
            elif nxt == "(" and t.text not in _NOT_CALLS:
                args, k, d = 0, i + 2, 1
                some = False
                while k < len(tokens) and d:
                    x = tokens[k].text
                    d += (x in "([{") - (x in ")]}")
                    if d and x not in ")":
                        some = True
                    args += d == 1 and x == ","
                    k += 1
                made = i > 0 and tokens[i - 1].text == "new"
                calls.append(dict(name=t.text, args=args + some, loop=loops(), branch=branches(), new=made))
                if made and loops():
                    m["alloc_in_loop"] += 1
                if t.text in _SCANS and loops():
                    m["linear_scan_in_loop"] += 1
                if t.text == name and not made:
                    m["self_recursive"] = True
                    m["recursion_in_loop"] |= loops() > 0
                    m["unguarded_recursion"] |= not guarded()
            elif t.text not in _NOT_CALLS:
                chain, k = 1, i
                while k + 2 < len(tokens) and tokens[k + 1].text in (".", "?.") and tokens[k + 2].kind == "id":
                    chain, k = chain + 1, k + 2
                m["max_access_depth"] = max(m["max_access_depth"], chain)
                uses.append((t.text, "WRITES" if nxt in ("=", "+=", "-=", "*=", "/=", "++", "--") else "USAGE"))
        i += 1
    return m, calls, uses


class Extractor:
    def __init__(self, project: str, path: str, text: str):
        self.project, self.path, self.t = project, path, lex(text)
        self.decls: list[Decl] = []
        self.imports: list[str] = []
        lines = text.count("\n") + 1
        self.file = Decl("File", path.rsplit("/", 1)[-1], file_qualified_name(project, path), "", 1, lines, dict(complexity=0, lines=lines, is_exported=False, is_test=False, is_entry_point=False))

    def skip(self, i: int, opening: str, closing: str) -> int:
        """The place after the bracket that closes the one at ``i``."""
        d = 0
        while i < len(self.t):
            d += (self.t[i].text == opening) - (self.t[i].text == closing)
            i += 1
            if d == 0:
                break
        return i

    def run(self) -> list[Decl]:
        self.members(0, len(self.t), [], None)
        return [self.file, *self.decls]

    def add(self, decl: Decl) -> None:
        self.decls.append(decl)

    def members(self, i: int, stop: int, scope: list[str], owner: Decl | None) -> None:
        while i < stop:
            mods: set[str] = set()
            attrs: list[str] = []
            while i < stop and (self.t[i].text == "[" or self.t[i].text in _MODIFIERS):
                if self.t[i].text == "[":
                    j = self.skip(i, "[", "]")
                    attrs += [x.text for x in self.t[i:j] if x.kind == "id"]
                    i = j
                else:
                    mods.add(self.t[i].text)
                    i += 1
            if i >= stop:
                return
            t = self.t[i]
            if t.text == "using":
                j = i
                while j < stop and self.t[j].text != ";":
                    j += 1
                name = "".join(x.text for x in self.t[i + 1 : j] if x.text not in ("static", "global"))
                self.imports.append(name.split("=")[-1])
                i = j + 1
            elif t.text == "namespace":
                j = i + 1
                while self.t[j].text not in ("{", ";"):
                    j += 1
                name = "".join(x.text for x in self.t[i + 1 : j])
                end = self.skip(j, "{", "}") if self.t[j].text == "{" else stop
                self.add(Decl("Namespace", name, f"{self.project}.{name}", self.file.qn, t.line, t.line, dict(complexity=0, lines=1, is_exported=True, is_test=False, is_entry_point=False)))
                self.members(j + 1, end - (self.t[j].text == "{"), [name], self.decls[-1])
                i = end
            elif t.text in _TYPES and i + 1 < stop and self.t[i + 1].kind == "id":
                i = self.type_(i, stop, scope, owner, mods)
            elif t.text == "delegate":
                j = i
                while j < stop and self.t[j].text != "(":
                    j += 1
                self.simple("Delegate", self.t[j - 1], scope, owner, mods)
                i = self.skip(j, "(", ")") + 1
            elif t.kind == "id":
                i = self.member(i, stop, scope, owner, mods, attrs)
            else:
                i += 1

    def type_(self, i: int, stop: int, scope: list[str], owner: Decl | None, mods: set[str]) -> int:
        label = _TYPES[self.t[i].text]
        i += 1 + (self.t[i + 1].text in ("class", "struct") and label == "Record")
        name = self.t[i]
        j = i + 1
        bases: list[str] = []
        while j < stop and self.t[j].text not in ("{", ";"):
            if self.t[j].text == "(":
                j = self.skip(j, "(", ")")
                continue
            if self.t[j].text == ":":
                k, d = j + 1, 0
                while k < stop and self.t[k].text not in ("{", ";", "where"):
                    d += (self.t[k].text in "<(") - (self.t[k].text in ">)")
                    if d == 0 and self.t[k].kind == "id" and self.t[k + 1].text != ".":
                        bases.append(self.t[k].text)
                    k += 1
                j = k
                continue
            j += 1
        end = self.skip(j, "{", "}") if j < stop and self.t[j].text == "{" else j + 1
        decl = self.simple(label, name, scope, owner, mods, self.t[min(end, len(self.t)) - 1].line)
        decl.bases = bases
        inner = [*scope, name.text]
        if label == "Enum":
            k = j + 1
            while k < end - 1:
                if self.t[k].kind == "id" and self.t[k - 1].text in ("{", ",", "]"):
                    self.simple("EnumMember", self.t[k], inner, decl, {"public"})
                k += 1
        elif self.t[j].text == "{":
            self.members(j + 1, end - 1, inner, decl)
        return end

    def simple(self, label: str, name: Token, scope: list[str], owner: Decl | None, mods: set[str], end: int | None = None) -> Decl:
        qn = ".".join([self.project, *scope, name.text])
        props = dict(complexity=0, lines=(end or name.line) - name.line + 1, is_exported=bool(mods & {"public", "protected"}), is_test=False, is_entry_point=False)
        if owner and owner.label in _TYPES.values():
            props["parent_class"] = owner.name
        self.add(Decl(label, name.text, qn, (owner or self.file).qn, name.line, end or name.line, props))
        return self.decls[-1]

    def member(self, i: int, stop: int, scope: list[str], owner: Decl | None, mods: set[str], attrs: list[str]) -> int:
        """A method, constructor, property, field or event from ``i``; the place after it."""
        j, d = i, 0
        while j < stop and not (d == 0 and self.t[j].text in ("(", "{", ";", "=", "=>")):
            d += (self.t[j].text in "<[") - (self.t[j].text in ">]")
            j += 1
        if j >= stop or j == i:
            return j + 1
        names = [k for k in range(i, j) if self.t[k].kind == "id"]
        if not names:
            return j + 1
        at = names[-1]
        if self.t[j].text == "(":  # generic methods: the name stands before the type parameters
            k = j - 1
            if self.t[k].text == ">":
                d = 0
                while k > i:
                    d += (self.t[k].text == ">") - (self.t[k].text == "<")
                    k -= 1
                    if d == 0:
                        break
            at = k
            return self.method(i, at, j, stop, scope, owner, mods, attrs)
        kind = "Event" if self.t[i].text == "event" else "Property" if self.t[j].text in ("{", "=>") else "Field"
        self.simple(kind, self.t[at], scope, owner, mods)
        if self.t[j].text == "{":
            j = self.skip(j, "{", "}")
            if j < stop and self.t[j].text == "=":
                while j < stop and self.t[j].text != ";":
                    j += 1
                j += 1
            return j
        d = 0
        while j < stop and not (d == 0 and self.t[j].text == ";"):
            d += (self.t[j].text in "([{") - (self.t[j].text in ")]}")
            j += 1
        return j + 1

    def method(self, i: int, at: int, j: int, stop: int, scope: list[str], owner: Decl | None, mods: set[str], attrs: list[str]) -> int:
        name = self.t[at]
        close = self.skip(j, "(", ")")
        inside = self.t[j + 1 : close - 1]
        params, d, part = [], 0, []
        for x in [*inside, Token("op", ",", 0)]:
            if x.text == "," and d == 0:
                if part:
                    cut = [y.text for y in part]
                    cut = cut[: cut.index("=")] if "=" in cut else cut
                    params.append(" ".join(["".join(cut[:-1]), cut[-1]]) if len(cut) > 1 else cut[0])
                part = []
                continue
            d += (x.text in "<([") - (x.text in ">)]")
            part.append(x)
        k = close
        while k < stop and self.t[k].text not in ("{", ";", "=>"):
            k += 1
        if k < stop and self.t[k].text == "{":
            end = self.skip(k, "{", "}")
            body = self.t[k + 1 : end - 1]
        elif k < stop and self.t[k].text == "=>":
            end = k
            while end < stop and self.t[end].text != ";":
                end += 1
            body, end = self.t[k + 1 : end], end + 1
        else:
            end, body = k + 1, []
        made = owner is not None and name.text == owner.name
        label = "Constructor" if made else "Method"
        returns = "".join(x.text for x in self.t[i:at])
        m, calls, uses = body_metrics(body, name.text)
        last = self.t[min(end, len(self.t)) - 1].line
        props = m | dict(
            param_count=len(params), lines=last - name.line + 1, is_exported=bool(mods & {"public", "protected"}), is_test=bool(_TESTS & set(attrs)),
            is_entry_point=name.text == "Main" and "static" in mods and returns in ("void", "int", "Task", "Task<int>"), signature=f"{name.text}({', '.join(params)})",
        )
        if not made:
            props["return_type"] = returns
        if owner is not None and owner.label in _TYPES.values():
            props["parent_class"] = owner.name
        qn = ".".join([self.project, *scope, f"{name.text}({', '.join(params)})"])
        self.add(Decl(label, name.text, qn, (owner or self.file).qn, name.line, last, props, calls=calls, uses=uses, overrides="override" in mods))
        return end




def _extract_batches(project: str):
    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf.file_path, pdf.text):
                ex = Extractor(project, path, text or "")
                for d in ex.run():
                    props = json.dumps({k: v for k, v in d.props.items() if v is not None})
                    rows.append(("node", project, path, d.label, d.name, d.qn, d.start, d.end, props, None, None, d.parent))
                    if d.parent:
                        kind = "DEFINES_METHOD" if d.label in ("Method", "Constructor") else "DEFINES"
                        rows.append(("defines", project, path, kind, d.name, d.parent, 0, 0, "{}", d.qn, None, None))
                    for b in d.bases:
                        rows.append(("base", project, path, d.label, d.name, d.qn, 0, 0, None, b, None, None))
                    for c in d.calls:
                        p = json.dumps(dict(confidence=1.0, strategy="lexical", arg_count=c["args"], loop_depth=c["loop"], branch_depth=c["branch"]))
                        rows.append(("new" if c["new"] else "call", project, path, d.label, d.name, d.qn, 0, 0, p, c["name"], c["args"], d.props.get("parent_class")))
                    for name, use in dict.fromkeys(d.uses):
                        rows.append(("use", project, path, use, d.name, d.qn, 0, 0, None, name, None, None))
                    if d.overrides:
                        rows.append(("override", project, path, d.label, d.name, d.qn, 0, 0, None, d.name, None, d.props.get("parent_class")))
                for name in ex.imports:
                    rows.append(("import", project, path, "IMPORTS", ex.file.name, ex.file.qn, 0, 0, None, name, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return run


def facts(files: DataFrame, project: str) -> DataFrame:
    """What each file (file_path, text) says on its own: declarations and unresolved references."""
    return files.select("file_path", "text").mapInPandas(_extract_batches(project), FACTS)


def extract(files: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (without ids) and named edges of files (file_path, text)."""
    from ..session import settle

    return link(settle(facts(files, project), "facts"))


def link(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve the facts of all files: nodes and named edges. The first declaration of a qualified name wins."""
    first = F.row_number().over(W.partitionBy("qualified_name").orderBy("file_path", "start_line"))
    nodes = rows.filter("kind = 'node'").withColumn("r", first).filter("r = 1")
    plain = F.to_json(F.struct(F.lit(1.0).alias("confidence"), F.lit("lexical").alias("strategy")))
    names = nodes.select(F.col("name").alias("target"), F.col("qualified_name").alias("target_qn"), F.col("label").alias("target_label"), F.try_variant_get(F.try_parse_json("properties"), "$.param_count", "int").alias("params"), F.col("parent").alias("target_parent"))

    def pick(df: DataFrame, kind, props) -> DataFrame:
        """One target for each source and name: an equal argument count first, then the smallest name."""
        best = df.groupBy("project", "qualified_name", "target", "args", "properties", "__type").agg(F.min(F.struct(F.coalesce(F.col("params") != F.col("args"), F.lit(True)), "target_qn")).alias("b"))
        return best.select("project", F.col("qualified_name").alias("source_qn"), F.col("b.target_qn").alias("target_qn"), F.col("__type").alias("type"), F.coalesce("properties", plain).alias("properties"))

    callable_ = F.col("target_label").isin("Method", "Constructor")
    typed = F.col("target_label").isin("Class", "Struct", "Record", "Interface")
    own = rows.join(names, "target")
    calls = own.filter((F.col("kind") == "call") & (F.col("target_label") == "Method") | (F.col("kind") == "new") & (F.col("target_label") == "Constructor")).withColumn("__type", F.lit("CALLS"))
    uses = own.filter((F.col("kind") == "use") & ~callable_ & F.col("target_label").isin("Field", "Property", "Event", "EnumMember", "Class", "Struct", "Record", "Interface", "Enum")).withColumn("__type", F.col("label"))
    bases = own.filter((F.col("kind") == "base") & typed).withColumn("__type", F.when((F.col("target_label") == "Interface") & (F.col("label") != "Interface"), "IMPLEMENTS").otherwise("INHERITS"))
    imports = own.filter((F.col("kind") == "import") & (F.col("target_label") == "Namespace")).withColumn("__type", F.lit("IMPORTS"))
    # an override goes to the method of its name in a base type
    parents = bases.select(F.col("name").alias("__child"), F.col("target").alias("__base")).distinct()
    over = rows.filter("kind = 'override'").join(parents, F.col("parent") == F.col("__child")).join(names.withColumnRenamed("target", "__t"), (F.col("target") == F.col("__t")) & callable_ & F.endswith("target_parent", F.concat(F.lit("."), F.col("__base")))).withColumn("__type", F.lit("OVERRIDES"))
    defines = rows.filter("kind = 'defines'").select("project", F.col("qualified_name").alias("source_qn"), F.col("target").alias("target_qn"), F.col("label").alias("type"), "properties")
    edges = defines
    for df in (calls, uses, bases, imports, over):
        edges = edges.unionByName(pick(df, None, None))
    return nodes.select("project", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties"), edges.filter("source_qn <> target_qn or type = 'CALLS'")


def index(files: DataFrame, project: str) -> Graph:
    """A full graph of files: nodes with ids, resolved edges, and transitive loop depths where above zero."""
    return index_facts(facts(files, project))


def index_facts(rows: DataFrame) -> Graph:
    from ..session import settle

    nodes, named = link(settle(rows, "facts"))
    nodes = with_ids(nodes)
    graph = Graph(nodes.select("id", "project", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties"), resolve_edges(named, nodes))
    return with_transitive_depth(graph)


def with_transitive_depth(graph: Graph) -> Graph:
    """``transitive_loop_depth`` written into the properties of nodes where it is above zero."""
    local = graph.nodes.select(F.col("id").alias("node_id"), F.try_variant_get(F.try_parse_json("properties"), "$.loop_depth", "int").alias("depth")).filter("depth > 0")
    depths = transitive_depth(graph, local).select(F.col("node_id").alias("id"), F.col("depth").alias("__d"))
    base = F.regexp_replace("properties", r',?\s*"transitive_loop_depth":\s*\d+', "")
    props = F.concat(F.regexp_replace(base, r"\}\s*$", ""), F.when(F.trim(base) == "{}", "").otherwise(","), F.lit('"transitive_loop_depth":'), F.col("__d").cast("string"), F.lit("}"))
    nodes = graph.nodes.join(depths, "id", "left").withColumn("properties", F.when(F.col("__d") > 0, props).otherwise(F.col("properties")))
    return Graph(nodes.select(*graph.nodes.columns), graph.edges)


by_value(__name__)
