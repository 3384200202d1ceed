"""Languages without a parser: line rules and the TypeScript import graph."""

from millrace.operators import langscan
from millrace.sources import files as sources


def test_line_rules(spark):
    texts = {
        "a.ts": "eval(x)\n// eval(x)\nel.innerHTML = y\nel.innerHTML = 'safe';\nconst sessionId = Math.random()\ndb.query(`select ${x}`)\ncrypto.createHash('md5')\n",
        "B.java": 'Runtime.getRuntime().exec(cmd);\nst.executeQuery("select " + x);\nMessageDigest.getInstance("SHA-256");\n',
        "c.go": 'import (\n\t"math/rand"\n)\nx := md5.Sum(b)\nc := &tls.Config{InsecureSkipVerify: true}\n',
        "d.php": "<?php\nsystem($cmd);\nsystem(escapeshellarg($cmd));\necho $_GET['x'];\n",
        "e.rs": 'Command::new("sh").arg("-c")\n',
        "f.py": "eval(x)\n",
    }
    got = {(r["path"], r["rule_id"], r["line"]) for r in langscan.scan_languages(sources.from_texts(spark, texts)).collect()}
    assert got == {("a.ts", "SKY-D201", 1), ("a.ts", "SKY-D226", 3), ("a.ts", "SKY-D250", 5), ("a.ts", "SKY-D211", 6), ("a.ts", "SKY-D207", 7), ("B.java", "SKY-D203", 1), ("B.java", "SKY-D211", 2), ("c.go", "SKY-D250", 2), ("c.go", "SKY-D207", 4), ("c.go", "SKY-D210", 5), ("d.php", "SKY-D203", 2), ("d.php", "SKY-D226", 4), ("e.rs", "SKY-D212", 1)}


def test_unused_typescript(spark):
    texts = {
        "src/index.ts": "import { a, type T } from './lib/a'\nimport d from \"./d.js\"\nexport * from './lib'\nconst z = require('./e')\n",
        "src/lib/a.ts": "export const a = 1\nexport const spare = 2\nexport interface T {}\nimport '../side'\n",
        "src/lib/index.ts": "export { b as c } from './b'\n",
        "src/lib/b.ts": "export const b = 1\nexport function lost() {}\n",
        "src/d.js": "export default 1\nexport const extra = 1\n",
        "src/e.ts": "export const all = 1\n",
        "src/side.ts": "export {}\n",
        "src/dead.ts": "import { a } from './lib/a'\nexport const x = a\n",
    }
    dead, unused = langscan.ts_unused(sources.from_texts(spark, texts))
    assert {r["path"] for r in dead.collect()} == {"src/dead.ts"}
    assert {(r["path"], r["name"]) for r in unused.collect()} == {("src/lib/a.ts", "spare"), ("src/lib/b.ts", "lost"), ("src/d.js", "extra")}
    none, _ = langscan.ts_unused(sources.from_texts(spark, {"src/x.ts": "export const x = 1\n"}))
    assert none.count() == 0
