"""Known profile databases."""

from __future__ import annotations

_FIELDS = ("name", "url", "molecule_type", "domain", "has_thresholds", "citation", "notes")
#: Public profile databases, where they are, and what they hold.
_ROWS = (
    ("PFAM", "https://ftp.ebi.ac.uk/pub/databases/Pfam/current_release/Pfam-A.hmm.gz", "protein", True, True, "Mistry et al. 2021, Nucleic Acids Res. 49:D412", "GA, TC and NC cutoffs"),
    ("KOFAM", "https://www.genome.jp/ftp/db/kofam/profiles.tar.gz", "protein", False, True, "Aramaki et al. 2020, Bioinformatics 36:2251", "thresholds come from a side table"),
    ("DFAM", "https://dfam.org/releases/Dfam_3.7/families/Dfam.hmm.gz", "nucleotide", False, False, "Storer et al. 2021, Mobile DNA 12:2", None),
    ("NCBI", "https://ftp.ncbi.nlm.nih.gov/hmm/current/hmm_PGAP.HMM.tgz", "protein", False, False, "Lu et al. 2020, Nucleic Acids Res. 48:D265", "holds TIGRFAM"),
    ("dbCAN", "https://bcb.unl.edu/dbCAN2/download/Databases/dbCAN-old@UGA/dbCAN-fam-HMMs.txt.v11", "protein", False, False, "Yin et al. 2012, Nucleic Acids Res. 40:W445", "usual E-value 1e-3"),
    ("VOGdb", "https://fileshare.csb.univie.ac.at/vog/latest/vog.hmm.tar.gz", "protein", False, False, "http://vogdb.org", "viral orthologs"),
    ("Resfam", "http://dantaslab.wustl.edu/resfams/Resfams-full.hmm.gz", "protein", False, False, "Gibson et al. 2015, ISME J. 9:207", "antibiotic resistance"),
    ("AntiFam", "https://ftp.ebi.ac.uk/pub/databases/Pfam/AntiFam/current/Antifam.tar.gz", "protein", False, True, "Eberhardt et al. 2012, Database bas003", "spurious reading frames"),
    ("FOAM", "http://files.cqls.oregonstate.edu/David_Lab/FOAM_version1/FOAM-hmm_rel1.hmm", "protein", False, False, "Prestat et al. 2014, Nucleic Acids Res. 42:e145", None),
    ("DefenseFinder", "https://github.com/mdmparis/defense-finder-models/tree/master/profiles/", "protein", False, False, "Tesson et al. 2022, Nat. Commun.", None),
    ("PADLOC", "https://github.com/padlocbio/padloc-db/tree/master/hmm/", "protein", False, False, "Payne et al. 2021, Nucleic Acids Res. 49:10868", None),
    ("CANT-HYD", "https://github.com/dgittins/CANT-HYD-HydrocarbonBiodegradation/blob/main/HMMs/concatenated%20HMMs/CANT-HYD.hmm", "protein", False, True, "Khot et al. 2022, Front. Microbiol. 12:764058", "TC and NC cutoffs"),
    ("NMPFamsDB", "https://bib.fleming.gr/NMPFamsDB/download_files/pHMMs_all.tgz", "protein", False, False, "Baltoumas et al. 2024, Nucleic Acids Res. 52:D592", None),
    ("barrnap", "https://github.com/tseemann/barrnap/tree/master/db", "nucleotide", False, False, "https://github.com/tseemann/barrnap", "16S and 23S rRNA"),
)
DATABASES = tuple(dict(zip(_FIELDS, row)) for row in _ROWS)
#: Where the thresholds of KOFAM are.
KOFAM_THRESHOLDS = "https://www.genome.jp/ftp/db/kofam/ko_list.gz"
