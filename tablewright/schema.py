"""Shapes of requests, tables and audited rows, as DDL."""

CELL = "struct<text:string,colspan:int,rowspan:int,header:boolean>"
TABLE = f"array<array<{CELL}>>"
MERGE = "struct<r1:int,c1:int,r2:int,c2:int>"
GRID = f"struct<grid:array<array<string>>,merges:array<{MERGE}>>"
NAMED = "struct<header:string,value:string>"
PART = "struct<type:string,text:string,image_url:struct<url:string>,file:struct<filename:string,file_data:string>>"
MESSAGE = f"struct<role:string,content:string,parts:array<{PART}>>"
ISSUE = "struct<seq:int,column:string,kind:string,detail:string>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"


def reshaped_rows(template: list[str], notes: str) -> str:
    """DDL of a reshaping service's answer: rows with src and a string for each column."""
    columns = [*template, *([notes] if notes not in template else [])]
    return "struct<rows:array<struct<src:int," + ",".join(f"`{c.replace('`', '``')}`:string" for c in columns) + ">>>"
