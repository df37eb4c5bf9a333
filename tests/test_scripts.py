"""Scripts as tokens: what may parse, forms, bracket partners against a stack, ends and signatures of functions."""

import random
import time

from sparkloom.functions import script_tokens as st
from sparkloom.functions import source_code as sc


def test_slashes_and_markup():
    assert st.may_parse("if (x) /[(]/.test(y);") is True  # behind a condition a pattern may begin
    assert st.may_parse("const a = (b) / 2 / (c)") is True and st.scan("a = (b) /[(]/ c").matched is False
    assert st.may_parse("const f = () => <p>{a && (<b>x</b>)} <i/></p>") is None and st.may_parse("<>it's</>") is None
    assert st.may_parse(r"const ab = 1; \u{61}()") is True
    assert st.may_parse("x = a.return / b / c; if (a) { } /re{/.test(x)") is True
    assert st.may_parse("x = {a: 1} / 2 / [3]") is True and st.may_parse("i++ / 2 / 1") is True
    assert st.may_parse("#!/usr/bin/env node's\nx = 1") is True
    assert st.may_parse("if (a < b && c > (d)) {}") is True  # comparisons are no markup
    assert [st.may_parse(x) for x in ("1 2 3", "'a' 'b'", "f(1 'a')", "let = = 3", "x = ;", "f(}", "/* a", "`${`", "'a\n'")] == [False] * 9
    assert [st.may_parse(x) for x in ("1\n2", "'use strict'\n'x'", "a = 1; 2", "", None, "x = `${ {a: '}'}.a + `${1}` }`")] == [True] * 6
    # more than a parser accepts, and stated so
    assert st.may_parse("foo bar baz") is True and st.may_parse("for (x) {}") is True


def test_line_breaks_that_end_a_statement():
    differ = [("return\n x", "return x"), ("a\n++b", "a++\nb"), ("throw\nx", "throw x"), ("continue\nl", "continue l"), ("yield\nx", "yield x"), ("a\n--\nb", "a--\nb")]
    assert [x for x in differ if st.canonical(x[0]) == st.canonical(x[1])] == []
    alike = [("return x // a", "return  x"), ("return (\n x)", "return (x)"), ("a\nb", "a\n\n  b"), ("f(a,\n b)", "f(a, b)"), ("x = a++ + b", "x = a++\n + b"), ("return /* c */ x", "return x")]
    assert [x for x in alike if st.canonical(x[0]) != st.canonical(x[1])] == []


def test_partners_equal_a_stack():
    rng = random.Random(9)
    parts = ["(", ")", "[", "]", "{", "}", " a ", "'}'", "`{${b}(`", "// {\n", "/* ( */", " = /[({]/", ";\n", "+ 1 "]
    for _ in range(400):
        source = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        t = st.scan(source)
        stack, want, whole = [], {}, True
        for i in range(len(t.kind)):
            x = t.text(i) if t.kind[i] == "mark" else ""
            if x and x in "([{":
                stack.append(i)
            elif x and x in ")]}":
                if stack and "([{".index(t.text(stack[-1])) == ")]}".index(x):
                    j = stack.pop()
                    want |= {i: j, j: i}
                else:
                    whole = False
        assert t.partner == [want.get(i, -1) for i in range(len(t.kind))] and t.matched == (whole and not stack)
        assert len(t.blank) == len(source) and t.blank.count("\n") == source.count("\n")


FUNCTIONS = """export default async function load(url, {a, b}, [c] = [], d = 1, ...rest) {
  return /[{]/.test(url) ? `}` : '}';
}
function k(a) { return /[{]/.test(a) }
const g = useCallback((a) => a)
const h = async <T,>(x: T): Promise<{ok: T}> => ({ ok: x })
export const twice = x =>
  x * 2
const wide = (a, b) => {
  if (a) { return b }
}, other = 3
const old = function named(q) { return q }
if (k) { function inner() {} }
class Box<T> extends Base {
  #hidden = { a: 1 }
  constructor(a) {
    this.a = a;
  }
  get size(): number { return this.a ? 1 : 2 }
  async open<K>(key: K, n = 1) {
    const go = () => { return 1 }
    for (const x of key) { this.check(x) }
  }
}
export class Out {
  run() { return 1 }
}
"""


def test_functions_and_signatures():
    js = {f["function_name"]: f for f in sc.script_functions(FUNCTIONS, "javascript")}
    assert {k: (f["start_line"], f["end_line"]) for k, f in js.items()} == {"load": (1, 3), "k": (4, 4), "h": (6, 6), "twice": (7, 8), "wide": (9, 11), "old": (12, 12), "Box.constructor": (16, 18), "Box.size": (19, 19), "Box.open": (20, 23)}
    assert {k: f["signature"] for k, f in js.items()} == {
        "load": "async function load(url, {...}, [...]=..., d=..., ...rest)", "k": "function k(a)", "h": "async function h(x)", "twice": "function twice(x)", "wide": "function wide(a, b)", "old": "function old(q)",
        "Box.constructor": "function Box.constructor(a)", "Box.size": "function Box.size()", "Box.open": "async function Box.open(key, n=...)",
    }
    assert js["Box.open"]["called_functions"] == ["this.check"] and js["Box.open"]["branch_count"] == 1 and js["Box.open"]["has_validation"] and js["Box.open"]["context_code"].startswith("class Box")
    assert js["k"]["called_functions"] == ["k", "test"] or js["k"]["called_functions"] == ["k"]
    ts = {f["function_name"]: f for f in sc.script_functions(FUNCTIONS, "typescript")}
    assert list(ts) == list(js)
    assert (ts["h"]["signature"], ts["twice"]["signature"], ts["Box.open"]["signature"]) == ("function h(x: T)", "function twice()", "function open(key: K, n = 1)")
    assert ts["twice"]["source_code"] == "twice = x =>\n  x * 2" and ts["load"]["source_code"].startswith("async function load(")


def test_functions_without_a_diff():
    got = [(f["function_name"], f["start_line"], f["end_line"]) for f in sc.script_functions_without_diff(FUNCTIONS)]
    assert got == [("load", 1, 3), ("k", 4, 4), ("h", 6, 6), ("twice", 7, 8), ("wide", 9, 11), ("old", 12, 12), ("Box_size", 19, 19), ("Box_open", 20, 23), ("Box_go", 21, 21), ("Out_run", 26, 26)]
    assert sc.script_class_source(FUNCTIONS, "Out") == "export class Out {\n  run() { return 1 }\n}" and sc.script_class_source(FUNCTIONS, "None") == ""


def test_time_grows_with_the_text():
    def seconds(n):
        source = "".join(f"function f{i}(a) {{ const b = `x ${{a}}`; return a / 2 + b.length; }} // it's\n" for i in range(n))
        began = time.process_time()
        assert len(sc.script_functions(source)) == n
        return time.process_time() - began

    small = seconds(3_000)
    assert seconds(24_000) < 24 * small + 1
