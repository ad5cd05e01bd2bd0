"""Symbols, imports and calls of Go and Java sources: golden values."""

import pytest

from tarnwork.sources import brace_symbols as b

GO = '''package main

import "fmt"

import (
    "os"
    myalias "encoding/json"
)

type Greeter struct {
    Name string
}

type Reader interface {
    Read(p []byte) (n int, err error)
}

type ID = string
type MyInt int

func (g *Greeter) Greet() string {
    return fmt.Sprintf("hello } %s", g.Name)
}

func (s *Server) Start(addr string, port int) error {
    return nil
}

func main() {
    // }
    g := Greeter{Name: "world"}
    fmt.Println(g.Greet())
    helper()
    (fog)()
    len(x)
}

func plain() {}
func named(a, b int) (n int, err error) { return 0, nil }
func variadic(prefix string, rest ...int) {}
func unnamed(int) {}
func parenResult() () { return }
func noBody()
'''


def by_name(rows, *kinds):
    return {x["name"]: x for x in rows if not kinds or x["kind"] in kinds}


def test_go():
    rows = list(b.go(GO))
    kinds = {x["name"]: x["kind"] for x in rows if x["kind"] in ("class", "interface", "type_alias", "function", "method")}
    assert kinds == {"Greeter": "class", "Reader": "interface", "ID": "type_alias", "MyInt": "type_alias", "Greet": "method", "Start": "method"} | dict.fromkeys("main plain named variadic unnamed parenResult noBody".split(), "function")
    f = by_name(rows, "function", "method")
    told = lambda n: (f[n]["param_types"], f[n]["param_count"], f[n]["return_type"])
    assert (f["Start"]["container"], *told("Start")) == ("Server", "string, int", 2, "error")
    assert told("plain") == (None, 0, None) and told("named") == ("int, int", 2, "(n int, err error)")
    assert told("variadic") == ("string, ...int", 2, None) and told("unnamed") == ("int", 1, None) and told("parenResult")[2] == "()"
    assert f["noBody"]["line"] == f["noBody"]["end_line"] and f["main"]["end_line"] - f["main"]["line"] == 7
    imports = by_name(rows, "import")
    assert len(imports) == 3 and imports["fmt"]["alias"] is None and (imports["json"]["container"], imports["json"]["alias"]) == ("encoding/json", "myalias")
    assert [(x["kind"], x["name"], x.get("receiver"), x["caller"]) for x in rows if "call" in x["kind"]] == [
        ("member-call", "Sprintf", "fmt", "Greet"), ("member-call", "Println", "fmt", "main"), ("member-call", "Greet", "g", "main"), ("call", "helper", None, "main"),
    ]


JAVA = '''package com.example;

import java.util.List;
import java.io.*;
import static java.lang.Math.PI;

public class Greeter extends Base<String> implements Runnable, Comparable<Dog> {
    private String name = make("class X {");
    private int[] sizes = new int[3];

    public Greeter(String name, final int size) {
        this.name = name;
        this(name);
    }

    @Override
    public String greet() {
        return format("hello %s", name); // }
    }

    @Route("/x") protected static <T> List<T> process(@Named("in") Map<String, List<T>> input, int... count) throws IOException, ParseException {
        if (count == null) { throw new IllegalStateException("no"); }
        Object o = new java.util.ArrayList<String>(3);
        return input.values().repeat(helper(count));
    }

    class Inner { void deep() { obj.process(); } }
}

interface Speaker {
    void speak();
}

enum Color {
    RED(1), GREEN(2);
    boolean isActive() { return this == RED; }
}
'''


def test_java():
    rows = list(b.java(JAVA))
    assert [(x["kind"], x["name"], x.get("container")) for x in rows if x["kind"] in ("class", "interface", "enum")] == [("class", "Greeter", None), ("class", "Inner", "Greeter"), ("interface", "Speaker", None), ("enum", "Color", None)]
    methods = {x["name"]: (x["container"], x["param_types"], x["param_count"], x["return_type"]) for x in rows if x["kind"] == "method"}
    assert methods == {
        "Greeter": ("Greeter", "String, int", 2, None), "greet": ("Greeter", None, 0, "String"), "process": ("Greeter", "Map<String, List<T>>, int...", 2, "List<T>"),
        "deep": ("Inner", None, 0, "void"), "speak": ("Speaker", None, 0, "void"), "isActive": ("Color", None, 0, "boolean"),
    }
    assert [(x["name"], x["container"]) for x in rows if x["kind"] == "import"] == [("List", "java.util.List"), ("io", "java.io"), ("PI", "static java.lang.Math.PI")]
    assert [(x["kind"], x["name"], x.get("receiver"), x["caller"]) for x in rows if "call" in x["kind"]] == [
        ("call", "format", None, "greet"), ("constructor-call", "IllegalStateException", None, "process"), ("constructor-call", "ArrayList", None, "process"),
        ("member-call", "values", "input", "process"), ("member-call", "repeat", None, "process"), ("call", "helper", None, "process"), ("member-call", "process", "obj", "deep"),
    ]


@pytest.mark.parametrize("text", ["", "}}}", "func", "func (", "import", "import (", "type", "class", "class A {", "public void f(", "{" * 5000, '"' * 999, "/*", "new", "new new(", "func (s) x(", "class A { A(", "type ("])
def test_broken_sources_do_not_fail(text):
    for read in b.LANGUAGES.values():
        list(read(text))


def test_table_of_files(spark):
    files = spark.createDataFrame([("a/x.go", GO), ("b/Y.java", JAVA), ("c.txt", "func a() {}"), ("e.go", None), ("e.java", "")], "path string, content string")
    got = b.symbols(files).groupBy("path", "language").count().collect()
    assert {(x["path"], x["language"], x["count"]) for x in got} == {("a/x.go", "go", len(list(b.go(GO)))), ("b/Y.java", "java", len(list(b.java(JAVA))))}
