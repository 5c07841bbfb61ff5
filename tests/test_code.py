"""Extractors of source code: each language's definitions, members, inheritance, imports and calls."""

import pytest

from vertexloom.sources import documents
from vertexloom.sources.code import LANGUAGES, code_edges

SAMPLES = {
    "py": "import os\nfrom a.b import c\nclass A(B, m.C):\n    x = 1\n    def run(self):\n        help()\ndef help():\n    return 'run()'  # run()\n",
    "ts": "import {x} from './lib';\nexport class A extends B {\n  run(a: string): void {\n    help();\n  }\n}\nexport function help() { return 1; }\n/* function no() {} */\n",
    "java": "package p;\nimport java.util.List;\npublic class A extends B {\n  private int x = 3;\n  public static void run(String[] args) {\n    help(1);\n  }\n  int help(int y) {\n    return new Foo(y).go();\n  }\n}\n",
    "rs": "use std::fmt;\npub struct A { a: i32 }\nimpl B for A {\n  fn run(&self) -> i32 {\n    help()\n  }\n}\npub fn help() -> i32 { 1 }\n",
    "rb": "require 'x'\nclass A < B\n  def run\n    help()\n  end\nend\ndef help\nend\n",
    "cpp": '#include <vector>\nclass A : public B {\n public:\n  void run() {\n    help();\n  }\n};\nint help() {\n  if (x) { return 1; }\n  return 2;\n}\n',
    "cs": "using System.Text;\nnamespace N {\n  public class A : B {\n    public void run() {\n      help();\n    }\n    static int help() { return 1; }\n  }\n}\n",
    "kt": "import a.b.C\nclass A(val x: Int) : B() {\n  fun run() {\n    help()\n  }\n}\nfun help() = 1\n",
    "scala": "import a.b.C\nclass A extends B {\n  def run() = {\n    help()\n  }\n}\nobject O {\n  def help() = 1\n}\n",
    "php": "<?php\nuse A\\B;\nclass A extends B {\n  public function run() {\n    help();\n  }\n}\nfunction help() {\n}\n",
    "swift": "import UIKit\nclass A: B {\n  func run() {\n    help()\n  }\n}\nfunc help() {}\n",
    "sol": 'import "./a.sol";\ncontract A is B {\n  function run() public {\n    help();\n  }\n  function help() internal {}\n}\n',
    "dart": "import 'x.dart';\nclass A extends B {\n  void run() {\n    help();\n  }\n}\nint help() {\n  return 1;\n}\n",
}
PLAIN = {
    "go": 'package main\nimport (\n  "fmt"\n)\ntype A struct {\n}\nfunc (t *A) run() {\n  help()\n}\nfunc help() {\n fmt.Println("run()")\n}\n',
    "lua": "local x = require('m')\nlocal function help()\nend\nfunction A:run()\n  help()\nend\n",
    "ex": "defmodule A do\n  alias X.Y\n  def run(x) do\n    help(x)\n  end\n  defp help(x), do: x\nend\n",
    "r": "library(dplyr)\nrun <- function(x) {\n  help(x)\n}\nhelp = function() {\n}\n",
    "jl": "using A\nfunction run()\n  help()\nend\nfunction help()\nend\n",
}


@pytest.mark.parametrize("extension", [*SAMPLES, *PLAIN])
def test_languages(extension):
    found = code_edges(SAMPLES.get(extension) or PLAIN[extension], extension)
    assert sum(r == "imports" for _, r, _ in found) == (2 if extension == "py" else 1)
    calls = {(s.strip("."), d.strip(".")) for s, r, d in found if r == "calls"}
    assert calls == {("run()", "help()")}
    if extension in SAMPLES:
        assert ("A", "inherits", "B") in found or ("A", "implements", "B") in found
        assert ("A", "method", ".run()") in found
    assert not [e for e in found if "no()" in e]


def test_shell_and_nesting():
    assert code_edges("source ./lib.sh\nhelp() {\n  echo 1\n}\nfunction run {\n  help\n}\n", "sh") == [("file", "imports", "./lib.sh"), ("file", "contains", "help()"), ("file", "contains", "run()")]
    assert ("outer()", "contains", "inner()") in code_edges("def outer():\n    def inner():\n        pass\n", "py")
    assert code_edges(None, "py") == code_edges("", "java") == []
    assert len(LANGUAGES) > 40


def test_extract_reads_whole_files_of_known_kinds(spark):
    rows = [("a.py", SAMPLES["py"]), ("b.java", SAMPLES["java"]), ("c.unknown", "x"), (None, "x"), ("d.ts", None), ("e.sql", "create function f() returns int as $$ begin insert into t values (1); update u set a = 1; end $$; create table t (id int);")]
    found = {tuple(r) for r in documents.extract(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert ("a.py", "A", "inherits", "m.C") in found and ("b.java", ".run()", "calls", ".help()") in found
    assert {r[1:] for r in found if r[0] == "e.sql" and r[2] == "writes_to"} == {("f", "writes_to", "t"), ("f", "writes_to", "u")}
    assert {r[0] for r in found} == {"a.py", "b.java", "e.sql"}
