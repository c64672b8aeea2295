"""Relational multigraphs as two tables: vertices (graph_id, v, kind, label) and arcs (graph_id, src, dst, relation, role, mult)."""
