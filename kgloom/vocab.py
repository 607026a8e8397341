"""IRIs and constants. Triples carry IRIs in angle brackets, temporal facts without."""

RDF_TYPE_IRI = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_TYPE = f"<{RDF_TYPE_IRI}>"
RDFS_LABEL = "<http://www.w3.org/2000/01/rdf-schema#label>"
DBO = "http://dbpedia.org/ontology/"
DBP = "http://dbpedia.org/property"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PAGE_LINK = DBO + "wikiPageWikiLink"
PAGE_ID = DBO + "wikiPageID"
#: End of a window that is still open, in epoch seconds.
OPEN_END = 9223372036854775807
