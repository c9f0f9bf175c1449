"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

TICKERS_JSON = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
SUBMISSIONS_JSON = "struct<sic: string, sicDescription: string, entityType: string, filings: struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>, primaryDocDescription: array<string>>>>"
COMPANY_FACTS_JSON = "struct<facts: struct<`us-gaap`: map<string, struct<units: map<string, array<struct<fp: string, fy: int, val: double, form: string, filed: string, end: string, accn: string>>>>>>>"
COMPANIES = "cik string, ticker string, company_name string, sic string, sic_description string, entity_type string, industry_group string, manual_include boolean"
FILINGS = "cik string, accession_number string, form_type string, filing_date string, report_date string, primary_document string, primary_doc_description string, filing_folder_url string, index_url string"
FACTS = "cik string, ticker string, concept string, value double, fy int, form string, filed string, end_date string, accession_number string"
EVIDENCE_ROW = "evidence_text string, text string, title string, ticker string, company_name string, fact_type string, direction string, filing_date string, source_url string, news_site string, language string, sourcecountry string, partition_0 string"
PAYLOAD = ("ticker", "company_name", "fact_type", "direction", "filing_date", "source_url", "news_site", "language", "sourcecountry", "partition_0")
GOLD = "ticker string, company_name string, claim string, label string, evidence array<struct<text: string, source_type: string, date: string, url: string>>, evidence_structured struct<texts: array<string>, dates: array<string>, source_types: array<string>, urls: array<string>>, metadata struct<original_group_size: bigint, sampled_group_size: bigint>"
