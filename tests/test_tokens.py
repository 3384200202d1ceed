"""Tokens, scopes and flows of TypeScript, Java and Go: lines that end with a mark must be reported, no other line may be."""

import re

from millrace.operators import tokenflow
from millrace.session import release_staged
from millrace.sources.files import from_texts
from millrace.sources.tokens import tokens

CODE = {
    "src/a.ts": r'''import { exec } from 'child_process'
import { clean, deep, pick } from './lib'
// exec(req.query.a)
const text = "exec(req.query.a)"
app.get('/a', (req, res) => {
  const cmd = req.query.cmd
  exec(`ls ${cmd}`)  // D212
  exec(clean(cmd))
  exec('ls')
  let q = 'safe'
  q += req.body.name
  db.query('select ' + q)  // D211
  db.query('select ?', [q])
  q = 'safe again'
  db.query(q)
})
app.get('/b', function (req, res) {
  const { id, name: other } = req.params
  if (id) {
    res.redirect(other)  // D230
  }
  let where = 'x'
  if (id > 3) {
    where = id
  }
  fetch(where)  // D216
  fetch(parseInt(id))
  const cmd = 'fixed'
  exec(cmd)
  deep(id)
})
function first(x) { return x }
const second = (x: string): string => x.trim().toLowerCase()
const third = async (x) => { return `${x}` }
const fixed = (x) => 'fixed'
export async function run(req: Request) {
  exec(first(req.body.a))  // D212
  exec(second(req.body.a))  // D212
  exec(await third(req.body.a))  // D212
  exec(fixed(req.body.a))
  el.innerHTML = req.query.html  // D226
  el.innerHTML = DOMPurify.sanitize(req.query.html)
  el.title = req.query.html
  const pattern = /["'`]/g
  let last = ''
  for (const item of req.body.items) {
    eval(last)  // D201
    last = item
  }
  exec(pick({ a: 1, b: req.query.b }))  // D212
  const o = { run: (v) => v, k: req.query.k }
  readFile(o.k, (err, data) => {})  // D215
}
function shadow(req) {
  let v = req.query.v
  {
    let v = 'inner'
    exec(v)
  }
  exec(v)  // D212
}
''',
    "src/lib.ts": """export function clean(v: string) { return encodeURIComponent(v) }
export function deep(v) {
  deeper(v, 1)
}
function deeper(v, n) {
  child_process.exec(v)  // D212
}
export function pick(o) {
  return o.b
}
""",
    "src/A.java": '''package a;
class A extends Base {
  private final Map<String, String> names = new HashMap<>();
  public void doGet(HttpServletRequest request, HttpServletResponse response) throws IOException {
    String id = request.getParameter("id");
    String sql = "select * from t where id=" + id;
    statement.executeQuery(sql); // D211
    statement.executeQuery("select * from t where id=" + Integer.parseInt(id));
    sql = "select 1";
    statement.executeQuery(sql);
    /* statement.executeQuery(id); */
    Runtime.getRuntime().exec(wrap(id, 3)); // D203
    Runtime.getRuntime().exec("ls");
    for (String part : id.split(",")) {
      new File(part); // D215
    }
    helper(names, id);
    response.sendRedirect(other(id));
  }
  private String wrap(final String text, int n) { return text + n; }
  private String other(String text) { return "x"; }
  void helper(Map<String, List<String>> all, String b) {
    response.sendRedirect(b); // D230
  }
}
''',
    "go/a.go": '''package a

import "os/exec"

func (s *Server) Handle(w http.ResponseWriter, r *http.Request) {
	id, err := r.FormValue("id"), 1
	if err != nil {
		return
	}
	exec.Command("sh", "-c", id) // D212
	exec.Command(`ls`, "id")
	q := fmt.Sprintf("select %s", id)
	s.db.Query(q) // D211
	s.db.Query("select ?", 1)
	n, _ := strconv.Atoi(id)
	http.Get(n)
	cfg := Config{Name: id}
	http.Get(cfg.Name) // D216
	open(id)
	os.Open(same(r.URL.Query().Get("f"))) // D215
	id = "fixed"
	http.Get(id)
}
''',
    "go/b.go": '''package a

func open(name string) {
	os.Remove(name) // D215
}

func same(a string) (string, error) {
	return a, nil
}
''',
}


def _marks(texts):
    return {(path, k, "SKY-" + m.group(1)) for path, text in texts.items() for k, line in enumerate(text.split("\n"), 1) if (m := re.search(r"// (\w\d+)$", line))}


def test_flows(spark):
    found = tokenflow.flow_findings(tokens(from_texts(spark, CODE))).collect()
    assert {(r["file"], r["line"], r["rule_id"]) for r in found} == _marks(CODE)
    assert len(found) == len(_marks(CODE))
    release_staged()


def test_places(spark):
    text = "const f = async (a, b) => g(a, { k: b })\nx.y?.z(1)\n  .then((r) => r.v)\nlet re = /[/'\"]/, s = `a${`b${c}`}`\n"
    rows = {(r["name"], r["line"]): r for r in tokens(from_texts(spark, {"a.ts": text})).where("name is not null").collect()}
    assert (rows["a", 1]["arg"], rows["b", 1]["arg"]) == (0, 1)
    assert rows["x.y.z", 2]["chain"] > 0 and ("x.y.z().then", 3) in rows
    assert rows["c", 4]["eq"] >= 0 and ("b", 4) not in rows


def test_texts_without_grammar(spark):
    """Null and empty texts, brackets that do not match, repeated rows, and other languages: defined, and no finding."""
    texts = {"a.ts": "", "b.ts": "}}}))) ]](", "c.go": "func (", "d.java": "class { \"", "e.ts": "`${`${", "f.py": "exec(req.query.a)", "g.ts": "=> = , ; :=", "h.ts": "/* exec(req.query.a)"}
    files = from_texts(spark, texts)
    files = files.unionByName(files.withColumn("text", files["text"].cast("string").substr(0, 0))).unionByName(files.limit(1).selectExpr("path", "lang", "cast(null as string) text"), allowMissingColumns=True)
    assert tokenflow.flow_findings(tokens(files)).count() == 0
    twice = from_texts(spark, {"a.ts": "exec(req.query.a)"})
    assert tokenflow.flow_findings(tokens(twice.unionByName(twice))).count() == 1
    assert tokens(twice.unionByName(twice)).count() == tokens(twice).count() > 0  # repeated files are dropped before they are tokens
    release_staged()


def test_long_files_take_linear_time():
    """Minified code of one line and one statement, and deep nesting."""
    import time

    from millrace.sources.tokens import _structure

    def took(text):
        start = time.time()
        n = sum(1 for _ in _structure("typescript", text))
        return time.time() - start, n

    for make in (lambda n: "var " + ",".join(f"a{k}=b{k}" for k in range(n)), lambda n: "f(" * n + ")" * n, lambda n: "x={a:1};" * n, lambda n: "`${" * n, lambda n: "f(a=>a,b);" * n):
        (a, _), (b, n) = took(make(4000)), took(make(16000))
        assert n > 4000 and b < 12 * a + 1
