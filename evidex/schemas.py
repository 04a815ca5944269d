"""Schemas of the records the library reads and makes, as DDL; nothing is inferred in production paths."""

from __future__ import annotations


SECTION = "struct<title:string,text:string,section_index:int,has_table:boolean,tables:array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>>"

#: Columns of a document and their types.
DOCUMENT = {
    "doc_id": "string", "title": "string", "content": "string", "abstract": "string", "authors": "array<string>", "year": "int", "journal": "string", "doi": "string", "pmid": "string",
    "mesh_terms": "array<string>", "keywords": "array<string>", "sections": f"array<{SECTION}>", "url": "string", "source_type": "string",
}
#: A PubMed article as the XML reader sees it, below the row tag.
PUBMED_ARTICLE = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,"
    "Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
    "Journal:struct<Title:string,ISOAbbreviation:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>,"
    "KeywordList:struct<Keyword:array<struct<_VALUE:string>>>>,"
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)
#: A PMC article as the XML reader sees it, below the row tag.
PMC_ARTICLE = (
    "front struct<`article-meta`:struct<`title-group`:struct<`article-title`:string>,abstract:struct<p:array<string>,_VALUE:string>,"
    "`pub-date`:array<struct<year:string>>,`article-id`:array<struct<_VALUE:string,`_pub-id-type`:string>>>>"
)
WHO_ITEM = ("name string, handle string, metadata array<struct<key:string,value:string>>")
CDC_ITEM = ("title string, description string, datePublished string, sourceUrl string")
EVENT = ("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
