"""Sources and sinks: FASTQ files and reads derived from text tables."""
