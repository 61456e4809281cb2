"""Resolved imports: aliases, endings, packages, and what is no import."""

from conftest import rows
from weft.operators import graph, imports

FILES = [
    ("web/app.ts", "import a from '~/lib/a'\nimport './style'\nexport * from \"../shared/index.js\"\nconst x = require('./old.js'), y = await import(`./no`)\n// import z from './gone'\nconst s = \"import q from './gone'\"\nimport r from 'react'\nimport { b } from '@/b'\n"),
    ("src/lib/a.tsx", "import { t } from '../types'\nimport self from './a'"),
    ("src/types/index.d.ts", ""),
    ("src/types/index.ts", None),
    ("shared/index.ts", "import app from '../web/app'"),
    ("web/old.js", ""),
    ("web/style.js", ""),
    ("web/gone.ts", ""),
    ("other/b.vue", ""),
    ("srv/main.py", '"""\nimport pkg.no\n"""\nimport os, pkg.deep as d\nfrom pkg import (models,  # a comment\n  views)\nfrom .local import x\nfrom . import sibling\nfrom pkg import *\n# from pkg import no\n'),
    ("srv/pkg/__init__.py", "from ..local import y"),
    ("srv/pkg/models.py", "from srv.local import z\nfrom pkg.views.inner import f"),
    ("srv/pkg/views/__init__.py", ""),
    ("srv/pkg/views/inner.py", ""),
    ("srv/pkg/no.py", ""),
    ("srv/pkg/deep.py", ""),
    ("srv/local.py", "import main"),
    ("srv/sibling.py", ""),
    ("pkg/models.py", ""),
]


def test_resolved_imports(spark):
    files = spark.createDataFrame(FILES, "file string, text string")
    aliases = spark.createDataFrame([("~/", "src"), ("@/", "other")], "prefix string, target string")
    edges = imports.resolved_imports(files, aliases)
    want = {
        "web/app.ts": ["other/b.vue", "shared/index.ts", "src/lib/a.tsx", "web/old.js", "web/style.js"],
        "src/lib/a.tsx": ["src/types/index.ts"],
        "shared/index.ts": ["web/app.ts"],
        "srv/main.py": ["srv/local.py", "srv/pkg/__init__.py", "srv/pkg/deep.py", "srv/pkg/models.py", "srv/pkg/views/__init__.py", "srv/sibling.py"],
        "srv/pkg/__init__.py": ["srv/local.py"],
        "srv/pkg/models.py": ["srv/local.py", "srv/pkg/views/inner.py"],
        "srv/local.py": ["srv/main.py"],
    }
    assert rows(edges) == sorted(((s, d) for s, ds in want.items() for d in ds), key=repr)
    assert imports.resolved_imports(files.where("false")).isEmpty()
    cycles = {r.node: r.component for r in graph.strong_components(edges).collect()}
    assert cycles["web/app.ts"] == cycles["shared/index.ts"] == "shared/index.ts" and cycles["srv/main.py"] == cycles["srv/local.py"]
