"""Quality on a small text with known relations: recall must reach what is recorded for rule-based extraction."""

from pyspark.sql import functions as F

from marginalia.operators import evaluation, extraction, phrases
from marginalia.operators.places import stored

#: The text, its entities and the relations that it tells, for which recalls are recorded.
TEXT = """
The Transformer architecture, introduced by Vaswani et al. at Google Brain in 2017,
revolutionized natural language processing. Unlike recurrent neural networks (RNNs)
and long short-term memory networks (LSTMs), the Transformer relies entirely on
self-attention mechanisms.

Devlin et al. at Google introduced BERT in 2018. BERT uses masked language modeling
and next sentence prediction for pre-training. The model achieved state-of-the-art
results on GLUE and SQuAD benchmarks.

OpenAI developed the GPT series. GPT-3 introduced few-shot learning with 175 billion
parameters. The model was trained on a diverse corpus of internet text.

Dosovitskiy et al. at Google Research introduced Vision Transformer (ViT) in 2020.
This approach applies the Transformer architecture to image classification.
ViT rivals CNNs on ImageNet classification while using fewer computational resources.
"""
ENTITIES = [
    ("Transformer", "TECHNOLOGY"), ("Vaswani et al.", "PERSON"), ("Google Brain", "ORGANIZATION"), ("Google", "ORGANIZATION"), ("RNNs", "TECHNOLOGY"), ("LSTMs", "TECHNOLOGY"),
    ("self-attention", "METHOD"), ("Devlin et al.", "PERSON"), ("BERT", "TECHNOLOGY"), ("masked language modeling", "METHOD"), ("pre-training", "METHOD"), ("GLUE", "DATASET"), ("SQuAD", "DATASET"),
    ("OpenAI", "ORGANIZATION"), ("GPT", "TECHNOLOGY"), ("GPT-3", "TECHNOLOGY"), ("Dosovitskiy et al.", "PERSON"), ("Vision Transformer", "TECHNOLOGY"), ("ViT", "TECHNOLOGY"), ("CNNs", "TECHNOLOGY"),
    ("ImageNet", "DATASET"), ("Google Research", "ORGANIZATION"),
]
EXPECTED = [
    ("Vaswani et al.", "Transformer", "INTRODUCES"), ("Devlin et al.", "BERT", "INTRODUCES"), ("Dosovitskiy et al.", "Vision Transformer", "INTRODUCES"), ("OpenAI", "GPT", "DEVELOPS"),
    ("Transformer", "self-attention", "USES"), ("BERT", "masked language modeling", "USES"), ("BERT", "GLUE", "EVALUATED_ON"), ("BERT", "SQuAD", "EVALUATED_ON"), ("ViT", "CNNs", "COMPETES_WITH"),
    ("ViT", "ImageNet", "EVALUATED_ON"), ("Vaswani et al.", "Google Brain", "AFFILIATED_WITH"), ("Devlin et al.", "Google", "AFFILIATED_WITH"), ("Dosovitskiy et al.", "Google Research", "AFFILIATED_WITH"),
]


def test_recall_of_known_relations(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id int, text string")
    ents = spark.createDataFrame([(1, i + 1, t, k) for i, (t, k) in enumerate(ENTITIES)], "doc_id int, ord int, text string, type string")
    told = stored(extraction.resolved(docs, ents))
    assert "The model (=BERT) achieved" in told.first().text.replace("\n", " ")
    held = stored(extraction.each_hit(extraction.sentence_hits(told, ents)).select("doc_id", "sent_id", "text", "type"))
    sents = extraction.sentence_rows(told)
    pick = lambda df: df.select("doc_id", "source", "target", "type")
    parsed = pick(extraction.dependency_relations(sents, held)).unionByName(pick(extraction.pattern_relations(told, ents)))
    parsed, slots = stored(parsed), stored(pick(phrases.slot_relations(sents, held)))
    expected = spark.createDataFrame([(1, *e) for e in EXPECTED], "doc_id int, source string, target string, type string")
    met, shares = evaluation.lenient(parsed.unionByName(slots), expected)
    assert shares.first().recall >= 0.6154
    exact = {(r.source, r.target) for r in met.where("met = 'exact'").collect()}
    assert {("Vaswani et al.", "Transformer"), ("Devlin et al.", "BERT"), ("BERT", "GLUE"), ("BERT", "SQuAD"), ("Vaswani et al.", "Google Brain"), ("Devlin et al.", "Google"), ("Dosovitskiy et al.", "Google Research")} <= exact
    whole = stored(extraction.pipeline(docs, ents))
    lenient = evaluation.lenient(pick(whole).unionByName(slots), expected)[1].first().recall
    assert lenient >= 0.8 and whole.select(F.max("rank")).first()[0] <= 100
