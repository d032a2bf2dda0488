import pytest

from quillgraph.extract import parse_source


def found(lang, text):
    r = parse_source(lang, "", text)
    return r.symbols, [(None if e is None else r.symbols[e][0], n) for e, n, _ in r.calls], [s[:4] for s in r.signals]


def test_python():
    text = "import os\n@app.get('/users/{id}?x')\ndef show(a=make()):\n    requests.post('https://h/api/pay')\n    return os.environ['PAY_KEY']\n\nclass K(Base):\n    @wrap\n    def m(self):\n        def inner(): self.n()\n        bus.publish('a.topic')\n        os.environ.get('HOME'); os.getenv('REGION_X'); f'{x}'.join(y)\n"
    symbols, calls, signals = found("python", text)
    assert [s[:2] for s in symbols] == [("show", "function"), ("K", "class"), ("m", "method"), ("inner", "function")]
    assert symbols[0][2:] == (3, 5)
    assert (None, "get") in calls and ("show", "make") in calls and ("inner", "n") in calls and ("m", "publish") in calls
    assert signals == [("wire", "/users/{id}", "in", "get"), ("wire", "/api/pay", "out", "post"), ("state", "PAY_KEY", "unknown", "env"), ("message", "a.topic", "out", "publish"), ("state", "REGION_X", "unknown", "env")]


def test_python_that_does_not_parse():
    symbols, calls, _ = found("python", "class A:\n    def f(self):\n        g(1)\n    def h(self)\n        k()\ntop(\n")
    assert [s[:2] for s in symbols] == [("A", "class"), ("f", "method"), ("h", "method")] and ("f", "g") in calls and ("h", "k") in calls and (None, "top") in calls


def test_typescript():
    text = """
import x from './lib';
import 'side';
@Controller()
export class Users extends Base {
  private cache = new Map<string, User>();
  handler = async (a: A): Promise<void> => { this.load(a); };
  @Get('/users') async list(q: Q): Promise<User[]> { return fetch('/api/list?x=1'); }
  constructor(private a: A) { super(a); }
}
export const go = (n) => n.map(step), plain = 3;
const one = x => two(x);
async function run() { if (a) { go(1); } /re"g(ex/.test(s); `t ${go(2)}`; new Users(a); new ns.Thing(); }
app.get('/api/x', (req) => help(req));
client?.post('/api/y'); http.get(`/api/${id}/z`); emitter.on('user.created', f); emitter.on('a b', f);
const k = process.env.PAY_KEY, l = import.meta.env['PAY_URL'], m = process.env.HOME;
const lib = require('pkg');
"""
    symbols, calls, signals = found("typescript", text)
    assert {s[:2] for s in symbols} == {("Users", "class"), ("handler", "function"), ("list", "method"), ("constructor", "method"), ("go", "function"), ("one", "function"), ("run", "function")}
    assert {("handler", "load"), ("list", "fetch"), ("run", "go"), ("run", "Users"), ("one", "two"), ("run", "test"), (None, "get"), (None, "help"), (None, "require")} <= set(calls)
    assert not {n for _, n in calls} & {"if", "Thing", "super", "run", "list"}
    assert signals == [
        ("import", "./lib", "out", "import"), ("import", "side", "out", "import"), ("wire", "/users", "in", "get"), ("wire", "/api/list", "out", "get"), ("wire", "/api/x", "in", "get"), ("wire", "/api/y", "out", "post"),
        ("wire", "/api/${id}/z", "out", "get"), ("message", "user.created", "in", "on"), ("state", "PAY_KEY", "unknown", "env"), ("state", "PAY_URL", "unknown", "env"), ("import", "pkg", "out", "require"),
    ]


def test_c():
    text = '#include "a.h"\n#include <b.h>\n#define F(x) gone(x)\nint proto(int);\nstatic char *\nname(int a)\n{\n  /* call(1) */ if (a) s->run(a); o.go();\n  return getenv("REGION_KEY") + use("x(\\"y(");\n}\n#if 0\nvoid dead(void) { live(); }\n#endif\n'
    symbols, calls, signals = found("c", text)
    assert symbols == [("name", "function", 5, 10), ("dead", "function", 12, 12)]
    assert calls == [("name", "run"), ("name", "go"), ("name", "getenv"), ("name", "use"), ("dead", "live")]
    assert signals == [("state", "REGION_KEY", "unknown", "env"), ("import", "a.h", "out", "include")]


def test_java():
    text = "package p;\n@X(y())\npublic class A<T> extends B {\n  private int n = make(1);\n  public A(int a) { super(a); run(); }\n  @Override\n  public <R> List<R> get(int x) throws E { return new ArrayList<R>(x).stream().map(f).toList(); }\n  abstract void none();\n  enum Kind { ONE, TWO }\n  record P(int x) {}\n}\ninterface I { void m(); }\n"
    symbols, calls, _ = found("java", text)
    assert [s[:2] for s in symbols] == [("A", "class"), ("A", "constructor"), ("get", "method"), ("none", "method"), ("Kind", "class"), ("P", "class"), ("I", "class"), ("m", "method")]
    assert {("A", "run"), ("get", "ArrayList"), ("get", "stream"), ("get", "map"), ("A", "make")} <= set(calls) and not {n for _, n in calls} & {"super", "X"}


def test_kotlin():
    text = "package p\ndata class D(val a: Int)\nclass S(val x: X) : Base(x), I {\n  override fun go(a: Int): Int = help(a) + 1\n  fun body() {\n    items.forEach { it.run() }\n  }\n  companion object Maker { fun make() = S(y()) }\n}\nfun String.ext() = trim()\nobject One { fun f() {} }\n"
    symbols, calls, _ = found("kotlin", text)
    assert [s[:2] for s in symbols] == [("D", "class"), ("S", "class"), ("go", "method"), ("body", "method"), ("Maker", "class"), ("make", "method"), ("ext", "function"), ("One", "class"), ("f", "method")]
    assert {("go", "help"), ("body", "forEach"), ("body", "run"), ("make", "S"), ("make", "y"), ("ext", "trim")} <= set(calls)


@pytest.mark.parametrize("lang", ["typescript", "c", "python", "java", "kotlin", "cobol", None])
@pytest.mark.parametrize("text", ["", "}}}((", "'", '"""', "/* open", "`${", "class", "fun (", "function", "const x =", "import", "new", "@", "\x00é{"])
def test_broken_texts_do_not_fail(lang, text):
    parse_source(lang, "", text)
