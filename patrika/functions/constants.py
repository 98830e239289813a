"""Character classes, rewrite dictionaries and rules, markers and messages. They are data, stated as they are."""

from __future__ import annotations


def _longest_first(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The order in which a dictionary is applied: longest keys first; equally long ones keep their order."""
    return sorted(pairs, key=lambda p: -len(p[0]))


# Fixed values from here on. Dictionary of font-encoded text; later entries with an equal key have replaced earlier ones.
LEGACY = _longest_first([
    ("AiÀÄ", "ಆ"), ("ªÀ", "ಅ"), ("EgÀ", "ಇ"), ("EgÀÄ", "ಈ"), ("GvÀÛ", "ಉ"), ("GvÀÛÄ", "ಊ"), ("F", "ಎ"), ("¥À", "ಏ"),
    ("AiÉÆ", "ಐ"), ("AiÀiÁ", "ಒ"), ("AiÀiÁÄ", "ಓ"), ("AiÀiï", "ಔ"), ("£À", "ನ"), ("PÀ", "ಡ"), ("gÀ", "ಗ"),
    ("µÀ", "ಮ"), ("zÀ", "ಜ"), ("dÄ", "ತ"), ("¸À", "ಸ"), ("¨sÀ", "ಹ"), ("®", "ಪ"), ("C", "ಚ"), ("r", "ರ"), ("¯À", "ಪ"),
    ("§", "ಲ"), ("ªÀiÁ", "ಯ"), ("ªÀÄ", "ವ"), ("²", "ಯ"), ("¢", "ಖ"), ("¤", "ಘ"), ("¥", "ಙ"), ("¦", "ಛ"), ("¨", "ಝ"),
    ("©", "ಞ"), ("ª", "ಟ"), ("«", "ಠ"), ("¬", "ಢ"), ("\u00ad", "ಣ"), ("¯", "ಫ"), ("°", "ಭ"), ("±", "ಮ"), ("³", "ರ"),
    ("´", "ಲ"), ("µ", "ವ"), ("¶", "ಶ"), ("·", "ಷ"), ("¸", "ಸ"), ("¹", "ಹ"), ("º", "ಳ"), ("»", "ೞ"), ("À", "ಾ"),
    ("Á", "ಿ"), ("Â", "ೀ"), ("Ã", "ು"), ("Ä", "ೂ"), ("Å", "ೃ"), ("Æ", "ೄ"), ("Ç", "ೆ"), ("È", "ೇ"), ("É", "ೈ"),
    ("Ê", "ೊ"), ("Ë", "ೋ"), ("Ì", "ೌ"), ("Í", "್"), ("MAಜ", "ಮಜ"), ("ಜA", "ಜ"), ("ºಾ", "ಸಾ"), ("ವಆ", "ವ"),
    ("ಸÛಡU", "ಸಂಡ"), ("ಾ¼ಾ", "ಾದಾ"), ("ಲU", "ಲ"), ("ೀR", "ೀರ"), ("åವA", "ಾವ"), ("æಆ", "ೆ"), ("ಚx", "ಚ"), ("ಾð", "ಾತ"),
    ("DVಗ", "ದ್ವಿಗ"), ("ಬæೂ", "ಬೊ"), ("ಜÝಗ", "ಜ್ಞಗ"), ("Áವಆ", "ಅವ"), ("åನ", "ಾನ"), ("ವä", "ವ"), ("ಗಲ", "ಗಲ"),
    ("ೆೆ", "ೆ"), ("ಮï", "ಮ"), ("nè", "ನೆ"), ("ದÕಗ", "ದಾಗ"), ("ಸೀ", "ಸೀ"), ("ಗಅಸ", "ಗಸ"), ("sÁಮ", "ಸಮ"),
    ("ತಜè", "ತಜೆ"), ("Áಜ", "ಅಜ"), ("ಗಏರ", "ಗರ"), ("Dಾಆ", "ದಾ"), ("DನA", "ದನ"), ("ವಾಗ", "ವಾಗ"), ("ಬಡëತ", "ಬಡತ"),
    ("EÁಸ", "ಇಸ"), ("ೆಆೀ", "ೆೀ"), ("ವಾÛೆ", "ವಾೆ"), ("ೂವ", "ೂವ"), ("ಾಗUಾ", "ಾಗಾ"), ("ವಆಅಗ", "ವಅಗ"), ("ೆVನ", "ೆನ"),
    ("åÏೀ", "ಾೀ"), ("UÁV", "ದಿ"), ("ಗಅ¹", "ಗ"), ("ಖÁAಡ", "ಖಡ"), ("Dzೆ", "ದಿ"), ("ೂಾº", "ೂಸ"), ("ೆುಗ", "ೆಗ"),
    ("ರ¹ವ", "ರವ"), ("ಾೀ", "ಾ"), ("ಿಎ", "ಇ"), ("ಮಆª", "ಮ"), ("Áಗ", "ಅಗ"), ("ಯನಜA", "ಯನಜ"), ("qಾ", "ಗಾ"), ("ಡೊ", "ಡೊ"),
    ("ÁV", ""), ("ೀß", "ೀ"), ("ಾ¼", "ಾದ"), ("ೆ½", "ೆ"), ("zೆ", "ಜೆ"), ("ಜÝ", "ಜ್ಞ"), ("ಕè", "ಕೆ"), ("zತ", "ಜತ"),
    ("ÁZ", "ಅ"), ("ೆU", "ೆ"), ("åÏ", "ಾ"), ("ರ¹", "ರ"), ("ªÁ", ""), ("Ýೂ", "ೂ"), ("ªೆ", "ೆ"), ("ಅð", "ಅತ"),
    ("üÁ", ""), ("æÆ", "ೆ"), ("Åz", ""), ("ೆA", "ೆ"), ("åQ", "ಾ"), ("Û", ""), ("ಸé", "ಸೆ"), ("Aೆ", "ೆ"), ("æೂ", "ೊ"),
    ("ುೂ", "ೂ"), ("AೆÜ", "ೆ"), ("ಸA", "ಸ"), ("Wಾ", "ವಾ"), ("Pೆ", "ಪೆ"), ("ೊಡ", "ೊಡ"), ("¼ಾ", "ದಾ"), ("ೀ¹", "ೀ"),
    ("ಏೊ", "ಏ"), ("ೆV", "ೆ"), ("ಾಗU", "ಾಗ"), ("ೂ¹", "ೂ"), ("ಾÛ", "ಾ"), ("ೀÛ", "ೀ"), ("ಾ½", "ಾ"), ("ಲUೆ", "ಲೆ"),
    ("ೌ", "ೌ"), ("ಏæಡ", "ಏಡ"), ("ುAqಾ", "ುಗಾ"), ("Áಅðದಡ", "ಅತದಡ"), ("ಚüÁæಆUಾ¼ಾ", "ಚೆದಾ"), ("ನೀß", "ನೀ"), ("Uಾ", "ದಾ"),
    ("ವ¹", "ವ"), ("ಯ", "ಯ"), ("ನå", "ನಾ"), ("ವ", "ವ"), ("ೀRåವAವæಆಅಗ", "ೀರಾವವೆಅಗ"), ("ു", "ು"),
    ("ಚxಾðಸಅಅಗ", "ಚಾತಸಅಅಗ"),
])

# Dictionary of misread characters.
MISREAD = _longest_first([
    ("0", "೦"), ("1", "೧"), ("2", "೨"), ("3", "೩"), ("4", "೪"), ("5", "೫"), ("6", "೬"), ("7", "೭"), ("8", "೮"),
    ("9", "೯"), ("o", "ೊ"), ("O", "ಒ"), ("e", "ೆ"), ("u", "ು"), ("i", "ಿ"), ("a", "ಅ"), ("|", "ಲ್"), ("l", "ಲ"),
    ("I", "ಇ"), ("S", "ಸ"), ("m", "ಮ"), ("n", "ನ"), ("r", "ರ"), ("t", "ತ"), ("d", "ದ"), ("p", "ಪ"), ("b", "ಬ"),
    ("k", "ಕ"), ("g", "ಗ"), ("j", "ಜ"), ("c", "ಚ"), ("h", "ಹ"), ("y", "ಯ"), ("v", "ವ"), ("w", "ವ"), ("MAಜ", "ಮಜ"),
    ("DVಗ", "ದ್ವಿಗ"), ("ಬæೂ", "ಬೊ"), ("ಜÝಗ", "ಜ್ಞಗ"), ("ದÕಗ", "ದಾಗ"), ("ಸÛಡ", "ಸಂಡ"), ("zsಾ", "ಸಾ"), ("ಚzs", "ಚಸ"),
    ("DನA", "ದನ"), ("ಬಡëತ", "ಬಡತ"), ("EÁಸ", "ಇಸ"), ("ಗಏರ", "ಗರ"), ("ಖÁA", "ಖ"), ("Dzೆ", "ದಿ"), ("ೂಾº", "ೂಸ"),
    ("ರ¹ವ", "ರವ"), ("Á", ""), ("ß", ""), ("¼", "ದ"), ("½", ""), ("¹", ""), ("Û", ""), ("Ý", ""), ("æ", ""), ("ü", ""),
    ("ð", "ತ"), ("è", "ೆ"), ("å", "ಾ"), ("ë", ""), ("Q", ""), ("Z", ""), ("X", ""), ("V", ""), ("A", ""), ("U", ""),
])

# What Python takes for white space, what it takes for a word character (nearly), and blocks of the script.
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_" + "\u0cdd"
SCRIPT = "\u0c80-\u0cff\u200c\u200d"
CONSONANT, LETTER, ANY, VOWEL_SIGN, DIGIT = "[ಕ-ಹ]", "[ಕ-ೞ]", "[ಅ-ೞ]", "[ಾ-ೌ]", "[೦-೯]"
MARKS = "[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff]"

# Rules on sequences, in order: pattern with groups, what stays. `<` and `>` stand for word boundaries.
RULES = [
    ("([ಕ-ಹ])A", "1"), ("([ಕ-ಹ])ಾA", "1ಾ"), ("([ಕ-ಹ])ೆA", "1ೆ"), ("([ಕ-ಹ])ೀA", "1ೀ"), ("([ಕ-ಹ])ೂA", "1ೂ"),
    ("([೦-೯])A", "1"), ("([೦-೯])ಾ", "1"), ("ಾಾ+", "ಾ"), ("ೆೆ+", "ೆ"), ("ೀೀ+", "ೀ"), ("ೂೂ+", "ೂ"),
    ("([ಕ-ಹ])ಆ([ಕ-ಹ])", "1 2"), ("([ಕ-ಹ])U([ಕ-ಹ])", "1 2"), ("([ಕ-ಹ])Á([ಕ-ಹ])", "1 2"),
    ("<A([ಕ-ಹ])", "1"), ("([ಕ-ಹ])A>", "1"), ("<Á", ""), ("Á>", ""),
]

# Markers of font encoding, of damaged recognition, letters to delete, fonts, scanner programs, signs of corruption.
MARKERS = "AiÀÄ ªÀ £À PÀ gÀ µÀ ¸À ¨sÀ dÄ zÀ".split()
DAMAGE = "MAಜ DVಗ ಸÛಡ ಜÝ Dzೆ ೂಾº ಬæೂ zsಾ ಚzs DನA".split()
DELETED = "Á ß ¼ ½ ¹ Û Ý æ ü ð å ë Q Z X".split()
FONTS = "Nudi BRH Baraha KGP Kedage Malige Akshar Hubballi Mallige Sampige Tunga".split()
SCANNERS = ["scan", "acrobat", "adobe scan", "camscanner", "genius scan"]
CORRUPTION = ["ೇೆ", "ವಿ ಪೄೆ", "K ಯುವವ", "ರರರ"]

# Messages.
ISSUES = {
    "blank": "Empty or whitespace-only text", "script": "Insufficient Kannada characters detected", "artifacts": "Excessive non-Kannada artifacts detected",
    "punctuation": "Excessive punctuation detected", "form": "Text not properly normalized",
}
NO_FILE, NOT_PDF, VALID = "No file selected", "File must be a PDF", "Valid"
DIGITAL_PLACEHOLDER = "ಈ PDF ಯಿಂದ ಯಾವುದೇ ಪಠ್ಯವನ್ನು ಹೊರತೆಗೆಯಲಾಗಲಿಲ್ಲ. ಇದು ಸ್ಕ್ಯಾನ್ ಮಾಡಿದ PDF ಆಗಿರಬಹುದು. 'Scanned PDF' ಮೋಡ್ ಅನ್ನು ಪ್ರಯತ್ನಿಸಿ."
#: Instead of a digital file's text that the repair leaves nothing of; before a failed file's error; a recognised file without text.
EMPTIED = 'ಪಠ್ಯ ಸಂಸ್ಕರಣೆಯಲ್ಲಿ ದೋಷ ಸಂಭವಿಸಿದೆ. PDF ಯಲ್ಲಿ ಪುರಾತನ ಫಾಂಟ್\u200cಗಳಿರಬಹುದು.'
FAILED = 'PDF ಸಂಸ್ಕರಣೆಯಲ್ಲಿ ದೋಷ: '
RECOGNISED_PLACEHOLDER = 'ಈ ದಾಖಲೆಯಿಂದ ಯಾವುದೇ ಪಠ್ಯವನ್ನು ಹೊರತೆಗೆಯಲಾಗಲಿಲ್ಲ.'
#: Lines of a recognised document: page heading, line of a page without text, of a failed page, and the summary.
PAGE_HEADING, PAGE_OF = "ಪುಟ %d", "ಪುಟ %d / %d"
NO_TEXT = '(ಈ ಪುಟದಲ್ಲಿ ಯಾವುದೇ ಪಠ್ಯ ಪತ್ತೆಯಾಗಿಲ್ಲ)'
PAGE_FAILED = "ಪುಟ %d ಸಂಸ್ಕರಣೆಯಲ್ಲಿ ದೋಷ: %s"
SUMMARY = "\nಸಾರಾಂಶ: %d/%d ಪುಟಗಳಿಂದ ಪಠ್ಯ ಹೊರತೆಗೆಯಲಾಗಿದೆ"
#: What is told of errors, by the error's kind.
NOT_VALID, NO_COMPONENTS = "Uploaded file is not a valid PDF.", "Required system components not found. Please check Tesseract installation."
NO_PERMISSION, UNEXPECTED = "Permission denied. Please check file permissions.", "An unexpected error occurred: %s"
#: Notes of the analysis, of text quality and of extraction.
FORCED_NOTE, FAILURE_NOTES = "Force OCR mode enabled by user", ("Analysis failed: %s", "Defaulting to OCR for safety")
QUALITY_NOTES = {
    "none": "No text extracted", "script": "Kannada text detected", "no_script": "No Kannada text detected", "length": "Substantial text length: %d chars",
    "few": "Low artifact ratio", "many": "High artifact ratio: %.2f", "words": "Found %d Kannada words",
}
EXTRACTED = ("PyMuPDF extracted %d chars from %d pages", "pdfplumber extracted %d chars", "PyPDF2 extracted %d chars")
ENCRYPTED, SCANNED_BY, FALLBACK = "PDF is encrypted", "Scanner software detected: ", "Used PyPDF2 fallback"
#: Settings under which one image is recognised for comparison.
SCRIPT_ONLY = "--oem 3 --psm 6 -c tessedit_char_whitelist=ಅ-ೞ೦-೯ -c preserve_interword_spaces=1"
ANY_CHARACTER = "--oem 3 --psm 6 -c preserve_interword_spaces=1"
OTHER_LAYOUTS, OTHER_SECONDS = [f"--oem 3 --psm {layout} -c preserve_interword_spaces=1" for layout in (3, 4, 8)], 15
CONFIGURATIONS = ["--oem 3 --psm 6", "--oem 3 --psm 6 -c tessedit_char_whitelist=ಅ-ೞ೦-೯", "--oem 3 --psm 3", "--oem 1 --psm 6"]
