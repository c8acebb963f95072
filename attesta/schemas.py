"""Record types as Spark schemas."""

PAPER = "doi string, title string, authors array<string>, year int, abstract string, source string, journal string, url string"
CITATION = "doi string, title string, first_author string, year int"
CLAIM = "row_number bigint, id string, doi string, claim string, source string, note string"
#: A registered answer of one source for one DOI: the record, or null with a typed error.
SOURCE_ANSWER = f"source_name string, doi_norm string, record struct<{', '.join(f.replace(' ', ':', 1) for f in PAPER.split(', '))}>, error_status string, error_reason string"
ATTEMPT = "struct<source:string,status:string,reason:string,record_id:string,doi:string,elapsed_ms:int>"
