"""The relations of a trace graph.

``ord`` places a row: the number of its scan root, its file, and its number in the file. Where order decides
(first definition, first seen, stable ties), it is this column that is compared, never the order of rows.
"""

from __future__ import annotations

ORD = "struct<root:int,path:string,seq:long>"
SECTIONS = f"path string, section_id string, title string, line long, anchor string, kind string, ord {ORD}"
ANCHORS = "path string, anchor string"
MAPPINGS = f"spec_path string, section_id string, line long, target string, kind string, target_path string, target_symbol string, ord {ORD}"
REFS = (
    "path string, owner_symbol string, line long, raw string, spec_path string, section_ids array<string>, anchor string, "
    f"ranges array<struct<start:string,end:string>>, ref_context string, ord {ORD}"
)
EDGES = "kind string, spec_path string, section_id string, code_path string, code_symbol string, line long"
INVARIANTS = (
    "invariant_id string, statement string, tier string, declaration_kind string, path string, line long, "
    f"owner_symbol string, section_id string, ord {ORD}"
)
BINDS = f"invariant_id string, test_path string, test_symbol string, marker_line long, start_line long, end_line long, ord {ORD}"
#: Findings as operators emit them; the policy join adds severity, default_severity and short_code.
FINDINGS = "code string, context string, path string, line long, message string, section_id string, symbol string, invariant_id string"
#: Files that were scanned, everything that exists, and the symbols of parsed files.
FILES = "path string"
SYMBOLS = "path string, symbol string"
