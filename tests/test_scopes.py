"""Facts of source files by tokens and scopes: names in strings and comments, nested members, heads of several lines, broken files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import chunks as K
from orrery.functions import scopes as S
from orrery.operators import indexing as N
from orrery.operators import structure as ST


def told(path, text, fact):
    keys = {"symbol": ("label", "kind", "start_line", "end_line", "parent"), "call": ("label", "start_line", "caller"), "import": ("label",)}[fact]
    return [tuple(r[k] for k in keys) for r in S.facts_of(path, text) if r["fact"] == fact]


TYPESCRIPT = """import React, { useState } from "react";
import "./side.css"; // import x from "no"
/* class Hidden { f() {} } */
const s = "function nope() {}", t = `x ${call1(`in ${deep({a: 1})}`)} function no2() {}`;
export default class LoginForm extends mix({}) {
  static async refresh<T>(
    a: number,
    b = { x: 1 },
  ): Promise<void> {
    if (a) { this.go?.(1); }
    return helper<string>(a) / 2 / other(b);
  }
  get name() { return 1 }
  constructor() { super(); new Foo(1); new a.Bar(2); }
}
export async function load(id) { return fetch(id).then(r => r.json()) }
const f = async (x: number): Promise<number> => {
  inner(x);
};
let g = x => x + 1
const k = (a, b) =>
  sum(a,
    b);
const r = /function x\\(\\) \\{/.test(s);
var h = function named() {};
const o = { meth(a) { return z() }, arrow: () => 1 };
"""


def test_typescript():
    assert told("a.ts", TYPESCRIPT, "symbol") == [
        ("LoginForm", "class", 5, 15, ""), ("refresh", "function", 6, 12, "LoginForm"), ("name", "function", 13, 13, "LoginForm"), ("constructor", "function", 14, 14, "LoginForm"),
        ("load", "function", 16, 16, ""), ("f", "symbol", 17, 19, ""), ("g", "symbol", 20, 20, ""), ("k", "symbol", 21, 23, ""), ("meth", "function", 26, 26, ""),
    ]
    assert told("a.tsx", TYPESCRIPT, "call") == [
        ("call1", 4, None), ("deep", 4, None), ("mix", 5, "LoginForm"), ("go", 10, "refresh"), ("helper", 11, "refresh"), ("other", 11, "refresh"), ("fetch", 16, "load"),
        ("then", 16, "load"), ("json", 16, "load"), ("inner", 18, "f"), ("sum", 22, "k"), ("test", 24, None), ("z", 26, "meth"),
    ]
    assert told("a.js", TYPESCRIPT, "import") == [("react",), ("./side.css",)]


CSHARP = """using System;
using static System.Math;
using X = A.B.C;
#region class Fake
namespace Demo.Deep
{
    // class No { void M() {} }
    [Attr("class Q { }")]
    public sealed class LoginService<T> : Base<T>, IFoo where T : class
    {
        private readonly int field = Compute(3);
        public LoginService(int x) : base(x) { Init(); }
        public bool Validate(string user,
            int n = 3)
        {
            return !string.IsNullOrWhiteSpace(user) && Other($"a {user} b");
        }
        [Obsolete] public Dictionary<string, List<int>> Map { get; set; } = new();
        public int Count => Items.Count();
        public static implicit operator int(LoginService<T> x) => 1;
        public event EventHandler Changed;
        public T this[int i] { get { return Get(i); } }
        void IFoo.Bar() => Baz();
        (int, string) Pair() { return (1, "x"); }
        public enum Mode { A, B = 2 }
        private struct Inner { public int X; int Y() { return 1; } }
        class Deeper { class Deepest { string P { get; } } }
        abstract void Later();
        string Verb => @"a ""class Z { }"" b";
    }
    public record Person(string Name, int Age);
    public interface IThing { void Do(); int Size { get; } }
}
"""


def test_csharp():
    own = "LoginService"
    assert told("A.cs", CSHARP, "symbol") == [
        (own, "class", 8, 30, ""), ("Validate", "method", 13, 17, own), ("Map", "property", 18, 18, own), ("Count", "property", 19, 19, own), ("Bar", "method", 23, 23, own), ("Pair", "method", 24, 24, own),
        ("Mode", "enum", 25, 25, own), ("Inner", "struct", 26, 26, own), ("Y", "method", 26, 26, "Inner"), ("Deeper", "class", 27, 27, own), ("Deepest", "class", 27, 27, "Deeper"),
        ("P", "property", 27, 27, "Deepest"), ("Later", "method", 28, 28, own), ("Verb", "property", 29, 29, own), ("Person", "record", 31, 31, ""), ("IThing", "interface", 32, 32, ""),
        ("Do", "method", 32, 32, "IThing"), ("Size", "property", 32, 32, "IThing"),
    ]
    assert told("A.cs", CSHARP, "call") == [("Compute", 11, own), ("Init", 12, own), ("IsNullOrWhiteSpace", 16, "Validate"), ("Other", 16, "Validate"), ("Count", 19, "Count"), ("Get", 22, own), ("Baz", 23, "Bar")]
    assert told("A.cs", CSHARP, "import") == [("System",), ("System.Math",), ("A.B.C",)]
    flat = "namespace Demo;\n\npublic class LoginService\n{\n    public bool Validate(string user)\n    {\n        return true;\n    }\n}\nConsole.WriteLine(1);\n"
    assert told("B.cs", flat, "symbol") == [("LoginService", "class", 3, 9, ""), ("Validate", "method", 5, 8, "LoginService")] and told("B.cs", flat, "call") == [("WriteLine", 10, None)]


GO = """package main
import "fmt"
import (
  a "net/http"
  . "os"
)
type Server struct {
  f func(int) int
}
type (
  A int
  B struct{ x int }
)
type ID string
func (s *Server) Handle(w http.Writer, r map[string]struct{}) (out struct{}, err error) {
  fmt.Println("func no() {}", `type X struct {`)
  go func() { s.run() }()
}
func Max[T any](a, b T) T { return pick(a, b) }
"""


def test_go_java_and_python():
    assert told("m.go", GO, "symbol") == [("Server", "symbol", 7, 9, ""), ("A", "symbol", 10, 13, ""), ("B", "symbol", 10, 13, ""), ("ID", "symbol", 14, 14, ""), ("Handle", "function", 15, 18, ""), ("Max", "function", 19, 19, "")]
    assert told("m.go", GO, "call") == [("Println", 16, "Handle"), ("run", 17, "Handle"), ("pick", 19, "Max")] and told("m.go", GO, "import") == [("fmt",), ("net/http",), ("os",)]
    java = 'package x;\nimport java.util.List;\n@Service(name = "class Z {}")\npublic class Main {\n  @Override\n  public <T> List<T> find(String q) throws E { return repo.all(q); }\n  public Main() { init(); }\n  interface In { void go(); }\n  String t = """\n    class Q { }\n  """;\n}\n'
    assert told("M.java", java, "symbol") == [("Main", "class", 3, 12, ""), ("find", "method", 5, 6, "Main"), ("In", "interface", 8, 8, "Main"), ("go", "method", 8, 8, "In")]
    assert told("M.java", java, "call") == [("all", 6, "find"), ("init", 7, "Main")] and told("M.java", java, "import") == [("java.util.List",)]
    py = 'import os, sys as s\nfrom a.b import c\nfrom . import d\n@deco(1)\nclass A(Base):\n    """def no(): pass"""\n    async def m(self,\n                x=call0()):\n        def inner():\n            return self.z(x)\n        return f"{g(1)} é" + inner()\n# def hidden(): pass\n'
    assert told("p.py", py, "symbol") == [("A", "class", 5, 11, ""), ("m", "function", 7, 11, "A"), ("inner", "function", 9, 10, "A")]
    assert told("p.py", py, "call") == [("deco", 4, None), ("call0", 8, "m"), ("z", 10, "inner"), ("g", 11, "m"), ("inner", 11, "m")] and told("p.py", py, "import") == [("os",), ("sys",), ("a.b",)]
    assert [S.facts_of(*x) for x in (("bad.py", "def ("), ("a.rs", "fn x() {}"), ("a.ts", None), (None, "x"), ("a.py", "x = 1\x00"))] == [None] * 5
    assert S.facts_of("a.ts", "") == []


def test_units_nest_and_broken_files_are_read():
    rng = random.Random(1)
    marks = "class struct func type import using namespace ( ) { } [ ] < > = => ; , . \" ' ` ${ / // /* */ @ a b T public static async const let function new ? ?. : \n 1".split(" ")
    for _ in range(3000):
        text = " ".join(rng.choice(marks) for _ in range(rng.randrange(50)))
        for path in ("a.ts", "a.cs", "a.go", "a.java"):
            for r in S.facts_of(path, text):
                assert 0 <= r["begin"] < r["stop"] <= len(text) and 1 <= r["start_line"] <= r["end_line"] <= text.count("\n") + 1
    deep = "class A { " * 3000 + "void m() {}" + " }" * 3000
    assert len(S.facts_of("a.cs", deep)) == 3001 and len(S.facts_of("a.ts", "f(" * 20_000)) == 20_000


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.ts", TYPESCRIPT), ("A.cs", CSHARP.replace("\n", "\r\n")), ("m.go", GO), ("bad.py", "import os\ndef old(:\n    go(1)\n"), ("x.sql", "CREATE TABLE t (a int);"), ("n.ts", None), ("e.ts", "")]
    return spark.createDataFrame(rows, "path string, content string")


def test_facts_as_a_table(files):
    got = {(r["path"], r["fact"], r["label"]): r for r in ST.all_facts(files).collect()}
    assert got["a.ts", "symbol", "refresh"]["parent"] == "LoginForm" and got["A.cs", "symbol", "Validate"]["start_line"] == 13
    assert ("a.ts", "symbol", "nope") not in got and ("a.ts", "symbol", "Hidden") not in got
    assert got["bad.py", "symbol", "old"]["kind"] == "function" and got["bad.py", "import", "os"]["fact"] == "import"  # by lines
    nodes, edges = ST.extraction(files)
    linked = {(r["a"], r["b"], r["relation"]) for r in edges.collect()}
    assert ("symbol:a.ts#LoginForm", "symbol:a.ts#refresh", "contains") in linked and ("symbol:a.ts#refresh", "call:a.ts#helper", "calls") in linked and ("file:m.go", "import:m.go#net/http", "imports") in linked
    assert {r["id"] for r in nodes.filter("kind = 'file'").collect()} == {f"file:{p}" for p in ("a.ts", "A.cs", "m.go", "bad.py", "x.sql", "n.ts", "e.ts")}


def test_chunks_follow_the_scopes(files):
    read = files.withColumn("facts", S.facts(F.col("path"), F.col("content")))
    found = read.select("path", F.explode(K.scoped_ranges(F.col("content"), F.col("facts"))).alias("r")).select("path", "r.*").collect()
    cs = {r["symbol"]: r for r in found if r["path"] == "A.cs"}
    assert cs["Validate"]["kind"] == "code_method" and cs["Validate"]["parent"] == "LoginService" and cs["Validate"]["body"].startswith("public bool Validate(string user,\n") and cs["Validate"]["body"].endswith("}")
    assert "field" not in cs and "A" not in cs and cs["Deepest"]["parent"] == "Deeper"
    rows = N.chunked(N.summarized(files.filter("content is not null")).withColumn("hash", F.lit("h")), "p").collect()
    assert {(r["path"], r["symbol"], r["parent"]) for r in rows} >= {("A.cs", "Map", "LoginService"), ("a.ts", "g", ""), ("x.sql", "t", "")}


@pytest.mark.parametrize("most", [24, 3])
def test_a_file_has_so_many_chunks(spark, most):
    one = spark.createDataFrame([("a.cs", "class A { " + " ".join(f"int P{i} => {i};" for i in range(60)) + " }")], "path string, content string")
    read = one.withColumn("facts", S.facts(F.col("path"), F.col("content")))
    assert read.select(F.size(K.scoped_ranges(F.col("content"), F.col("facts"), most)).alias("n")).first()["n"] == most
