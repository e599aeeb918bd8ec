"""Small literal inputs for operators that the supplied tables don't cover."""

URLS = [
    "https://docs.example.com/docs/", "https://docs.example.com/docs/getting-started", "https://docs.example.com/docs/api/reference", "https://docs.example.com/docs/guide/install#top",
    "https://docs.example.com/login", "https://docs.example.com/pricing/enterprise", "https://docs.example.com/logo.png", "https://docs.example.com/blog/page/2", "https://docs.example.com/a?page=3",
    "https://docs.example.com/a?utm_source=x", "https://docs.example.com/tag/python/", "https://docs.example.com/users/ann", "https://docs.example.com/2024/05/01/post", "https://docs.example.com/v1.2.3/intro",
    "https://docs.example.com/tests/fixtures", "https://docs.example.com/archive/old", "https://docs.example.com/a/b/c/d/e/f/g/h", "https://other.org/wiki/Start", "https://example.com/tutorial",
    "https://github.com/owner/name", "https://github.com/owner/name.git", "https://github.com/owner/name/blob/main/README.md", "https://github.com/owner/name/blob/main/src/app.py", "https://github.com/owner/name/stargazers",
    "https://github.com/owner/name/pulse", "https://github.com/topics/spark", "https://stackoverflow.com/questions/tagged/spark", "https://spark.readthedocs.io/en/latest/", "https://docs.python.org/3/library/re.html",
    "https://nodejs.org/en/docs", "https://react.dev/learn", "https://user:secret@Example.org:8080/path/?q=1", "ftp://example.org/file", "not a url", "http://localhost/x", "http://10.0.0.1/", "http://192.168.1.5:80/a",
    "http://169.254.169.254/latest", "http://[::1]/", "http://service.internal/x", "https://8.8.8.8/dns", "https://example.org/#combined",
]

CODE = [
    (1, "import requests\nfrom os import path\n\ndef hello():\n    return 1\n\nclass MyClass:\n    pass"),
    (2, "const x = require('y');\nfunction go() { return x => x }\nlet z = 1;"),
    (3, "interface Shape { kind: string }\ntype Id = number;\nconst area = (s: Shape): number => 1;"),
    (4, "fn main() { let mut x = 1; }\nimpl Foo {}"),
    (5, "package main\nfunc (s *S) Run() { x := 1 }\nfunc main() {}"),
    (6, "SELECT a FROM b WHERE c = 1"),
    (7, "nothing at all"),
]

FILES = [
    ("web", "package.json", '{"dependencies": {"react": "18", "left-pad": "1"}, "devDependencies": {"vite": "5"}}'),
    ("web", "src/index.js", "export default function App() { return 1 }\nexport const helper = 2\n" + "// line\n" * 120),
    ("web", "node_modules/x/index.js", "export const hidden = 1"),
    ("lib", "pyproject.toml", 'dependencies = ["numpy>=1.0", "pandas"]'),
    ("lib", "src/lib/core.py", "def load(x):\n    pass\n\nclass Table:\n    pass\n\ndef _private():\n    pass\n"),
    ("lib", "tests/test_core.py", "def test_load():\n    pass\n"),
    ("lib", "README.md", "# Library\n" + "words " * 40),
    ("tool", "Cargo.toml", "[dependencies]\nserde = \"1\"\ntokio = \"1\"\n"),
    ("tool", "src/main.rs", "pub fn run() {}\nfn hidden() {}\n"),
    ("svc", "go.mod", "module x\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
    ("svc", "main.go", "package main\nfunc Serve() {}\nfunc main() {}\n"),
    ("none", "notes.txt", "text"),
]
