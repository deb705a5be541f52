"""Python, through its own parser."""

from __future__ import annotations

import ast

from tessera.languages.registry import Extract, Symbol, language


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


@language("python")
def extract(text: str) -> Extract:
    out = Extract()

    def walk(node: ast.AST, owner: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                out.symbols.append(Symbol(n.name, "method" if owner else "function", first - 1, n.end_lineno - 1, owner))
            elif isinstance(n, ast.ClassDef):
                out.symbols.append(Symbol(n.name, "class", n.lineno - 1, n.end_lineno - 1, owner))
                out.relations += [(n.lineno - 1, n.name, "extends", base.rpartition(".")[2]) for b in n.bases if (base := _dotted(b))]
                inner = n.name
            elif isinstance(n, ast.Import):
                out.imports += [a.name for a in n.names]
                out.bindings += [(a.asname, None, a.name) for a in n.names if a.asname]
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                out.imports.append(module)
                out.bindings += [(a.asname or a.name, a.name, module) for a in n.names if a.name != "*"]
            elif isinstance(n, ast.Call) and (name := _dotted(n.func)):
                q, _, last = name.rpartition(".")
                out.calls.append((n.lineno - 1, last, q.replace(".", "::") or None))
            elif isinstance(n, ast.Assign) and node.__class__ is ast.Module and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets):
                out.exports += [e.value for e in getattr(n.value, "elts", []) if isinstance(e, ast.Constant)]
            walk(n, inner)

    tree = ast.parse(text)
    walk(tree, None)
    out.exports = out.exports or [s.name for s in out.symbols if s.owner is None and not s.name.startswith("_")]
    return out
