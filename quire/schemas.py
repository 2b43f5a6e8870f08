"""Schemas at the stage boundaries. Every row carries doc_id and an order key."""

from __future__ import annotations

OBJECTS = "doc_id string, obj_no int, type string, page_idx int, text string, text_level int, img_path string, table_body string"
LAYOUT_FILE = "array<struct<type:string,page_idx:int,text:string,text_level:int,img_path:string,table_body:string>>"
LINES = "doc_id string, line_no int, line string"
PAGES = "doc_id string, page_num int, text string, ocr_text string"
TITLES = "doc_id string, ord int, title string, level int, top_idx int, parent string"
BLOCKS = "doc_id string, page_idx int, reading_order int, h1 string, h2 string, h3 string, h4 string, data_type string, data string, table_path string"
RUN_LOG = "experiment string, doc_id string, stage string, success boolean, duration double, operations int, error string"
FILES = "path string, folder string, name string, size bigint, modified timestamp"
CACHE = "key string, ts timestamp, result string"
