"""Predictors behind a web service: one request a sequence and allele, sent from the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitrail.functions.alleles import normalize_allele
from epitrail.operators.combine import pairs
from epitrail.operators.windows import distinct_peptides, peptide_lengths, peptides, sequences
from epitrail.predictors.base import Predictor
from epitrail.schema import canonical
from epitrail.sources.stdout import parse_iedb

URL = "http://tools-cluster-interface.iedb.org/tools_api/{}/"

# The service's names of methods.
METHODS = {
    "netmhcpan-iedb": ("netmhcpan", "mhci"),
    "netmhccons-iedb": ("netmhccons", "mhci"),
    "smm-iedb": ("smm", "mhci"),
    "smm-pmbec-iedb": ("smmpmbec", "mhci"),
    "netmhciipan-iedb": ("NetMHCIIpan", "mhcii"),
}


def post(url: str, fields: dict) -> str:
    """The response to a form."""
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    return urlopen(Request(url, urlencode(fields).encode("ascii")), timeout=600).read().decode("utf-8")


class IedbPredictor(Predictor):
    """IEDB's service. With ``strict`` off, failed requests are left out; :meth:`failures` lists them."""

    validates = True

    def __init__(self, spark, alleles=(), method: str = "netmhcpan-iedb", url: str | None = None, send: Callable[[str, dict], str] = post, strict: bool = True, **options):
        if method not in METHODS:
            raise ValueError(f"Unknown method {method!r}")
        self.name, (self.method, site) = method, METHODS[method]
        self.class2 = site == "mhcii"
        self.url, self.send, self.strict = url or URL.format(site), send, strict
        self.default_lengths = tuple(range(15, 21)) if self.class2 else (8, 9, 10, 11)
        self.least_length = 9 if self.class2 else 8
        super().__init__(spark, alleles, **options)

    def requests(self, asked: DataFrame) -> DataFrame:
        """``text, error`` of each request of ``seq, allele, k``."""
        method, url, send, class2 = self.method, self.url, self.send, self.class2

        def run(batches: Iterator) -> Iterator:
            for pdf in batches:
                texts, errors = [], []
                for seq, allele, k in pdf[["seq", "allele", "k"]].itertuples(index=False):
                    fields = {"method": method, "sequence_text": seq, "allele": allele}
                    if not class2:
                        fields["length"] = str(k)
                    try:
                        texts.append(send(url, fields))
                        errors.append(None)
                    except Exception as e:  # the caller decides what a failed request means
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pdf.assign(text=texts, error=errors)

        spelled = asked.select("name", "seq", normalize_allele(F.col("allele"), omit_dra1=class2).alias("allele"), "k")
        return spelled.mapInPandas(run, "name string, seq string, allele string, k int, text string, error string")

    def failures(self, answered: DataFrame) -> DataFrame:
        return answered.where("error IS NOT NULL").select("name", "seq", "allele", "k", "error")

    def _rows(self, asked: DataFrame) -> DataFrame:
        got = self.requests(asked)
        if self.strict:
            failed = F.raise_error(F.concat(F.lit("Request failed: "), "error")).cast("string")
            got = got.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(failed))
        else:
            got = got.where("error IS NULL")
        return got

    def score(self, asked: DataFrame) -> DataFrame:
        one = asked.select(F.lit("").alias("name"), F.col("peptide").alias("seq"), "allele", F.length("peptide").alias("k"))
        rows = parse_iedb(self._rows(one), self.name)
        return rows.withColumn("allele", normalize_allele(F.col("allele"))).drop("ord")

    def predict_proteins(self, given, lengths=None, validate: bool = False) -> DataFrame:
        """The service slides the windows itself: one request a sequence, allele and length."""
        df = given if isinstance(given, DataFrame) else sequences(self.spark, given)
        lengths = peptide_lengths(lengths, self.default_lengths, self.least_length)
        asked = pairs(df.select("name", "seq"), self.alleles).select("name", "seq", "allele", F.explode(F.array(*map(F.lit, lengths))).alias("k"))
        got = self._rows(asked.where(F.length("seq") >= F.col("k")))
        rows = parse_iedb(got, self.name, source="name")
        return canonical(rows.withColumn("allele", normalize_allele(F.col("allele"))))

    def predict(self, given, validate: bool = False) -> DataFrame:
        df = given if isinstance(given, DataFrame) else peptides(self.spark, given)
        return super().predict(distinct_peptides(df), validate)

