"""User-defined surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def map_batches(df: DataFrame, fn, schema, columns: list | None = None) -> DataFrame:
    """Run ``fn(pyarrow.RecordBatch) -> pyarrow.RecordBatch`` over Arrow batches of the
    named columns (the batched-map surface); prefer native columns where they suffice."""
    src = df.select(*columns) if columns else df

    def run(batches):
        for b in batches:
            yield fn(b)

    return src.mapInArrow(run, schema)


def collate(df: DataFrame, mode: str, **cfg) -> DataFrame:
    """Pick the collator by mode: 'span' (E16), 'complement' (E17) or 'instruction' (C8-C12)."""
    if mode == "span":
        from spanweave.operators.corrupt import corrupt
        return corrupt(df, **cfg)
    if mode == "complement":
        from spanweave.operators.corrupt import corrupt_complement
        return corrupt_complement(df, **cfg)
    if mode == "instruction":
        return collate_instructions(df, **cfg)
    raise ValueError(f"unknown collator mode {mode!r}")


def collate_instructions(df: DataFrame, vocab: DataFrame, max_source_length: int = 1024,
                         max_target_length: int = 128, overflow: str = "chunk") -> DataFrame:
    """Prompts (C8-C9) and references (C11) encoded to model inputs: ``input_ids`` and ``attention_mask``
    padded to the source length, ``labels`` to the target length with -100.

    Whole texts: examples are admitted by the ids of the whole prompt, and what is still longer goes on in
    further rows, one for each pair of ``source_chunk`` and ``target_chunk``. ``overflow="truncate"`` is
    the reference's collator: both lengths cut what is longer."""
    from spanweave.operators.instructions import choose_reference, render_instruction
    from spanweave.operators.vocab import encode, encode_labels
    whole = overflow == "chunk"
    # instances are short rows, but their texts take long: not as few tasks as the rows' size asks for
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = choose_reference(render_instruction(df, max_source_length=max_source_length, vocab=vocab if whole else None))
    d = encode(d, "source", vocab, max_source_length, overflow=overflow)
    d = encode_labels(d.withColumnRenamed("chunk", "source_chunk"), "target", vocab, max_target_length, overflow=overflow)
    return d.withColumnRenamed("chunk", "target_chunk")
