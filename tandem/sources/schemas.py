"""Schemas of the entities that are read and written (E1-E22)."""

from __future__ import annotations

FILE_MOD = "filename string, added_lines int, deleted_lines int, old_path string, new_path string, diff string, modified_lines array<int>"
FUNCTION_MOD = "function_name string, filename string, file_path string, lines_modified array<int>, specific_modified_lines array<int>, language string, parameters array<string>, body_size int"
COMMIT = f"""hash string, author struct<name:string,email:string>, committer_date string, message string, added_lines int, deleted_lines int,
 files_modified array<struct<{", ".join(":".join(x.split(" ", 1)) for x in FILE_MOD.split(", "))}>>,
 functions_modified array<struct<{", ".join(":".join(x.split(" ", 1)) for x in FUNCTION_MOD.split(", "))}>>"""
METADATA = "name string, file_path string, start_line int, end_line int, language string, parameters array<string>, body_code string, class_name string, module_path string, arg_count int"
METADATA_MAP = f"map<string, struct<{METADATA.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>"
NODES = f"node_id string, {METADATA}"
EDGES = "src string, dst string, call_line int"
PAIR_META = "type:string,distance:int,cochange_count:int,unique_authors:int,avg_time_gap:double,func1_modify_count:int,func2_modify_count:int,timestamps:array<string>,file_path:string"
PAIR = f"struct<func1:string,func2:string,label:int,metadata:struct<{PAIR_META}>>"
LABELS = f"train array<{PAIR}>, val array<{PAIR}>, test array<{PAIR}>, test_pairs array<{PAIR}>"
EVOLUTION = "modify_count:int,authors:array<string>,commit_times:array<string>"
STATS = "total_commits long, total_authors array<string>, file_extensions map<string,long>, monthly_activity map<string,long>, total_files_changed long, total_added_lines long, total_deleted_lines long, function_modifications map<string,long>, total_functions_changed long"
