"""The same results in SQL, written independently of the Spark plans.

`norm(x)` and friends are text templates, because a registered query is one statement.
"""

from __future__ import annotations

from paracorpus.functions.text import PUNCTUATION, WHITESPACE
from paracorpus.plans.views import BATCH_SIZE, BOS, MISHEARD, TOKENS_PER_PAIR, UNIT_OF_EVENT


def norm(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '{PUNCTUATION}', '', 'g')"
    return f"regexp_replace(regexp_replace({plain}, '{WHITESPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WHITESPACE}+', ''), '{WHITESPACE}+$', '')"


def blank(x: str) -> str:
    return f"coalesce({strip(x)}, '') = ''"


def misheard(x: str) -> str:
    for said, heard in MISHEARD:
        x = f"replace({x}, '{said}', '{heard}')"
    return x


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def digest(x: str) -> str:
    return f"md5(array_to_string({x}, ' '))"


STEM = (
    "case when lang <> 'es' then concat('P-', source, '-', lang, '_', doc_id) "
    "else concat('x_', doc_id) end"
)
NAMED = f"named as (select *, {STEM} as stem from documents)"
SPEAKER = "case when starts_with(stem, 'P-') then split_part(stem, '_', 1) end"
REPLIES = """replies as (
  select concat(a.conv_id, '_', a.turn) as id, a.text as reference, b.text as hypothesis,
         case when b.text is null then 'no reply' end as error
  from conversations a
  left join conversations b
    on b.conv_id = a.conv_id and b.turn = a.turn + 1 and b.role = 'assistant'
  where a.role = 'user')"""
RECORDINGS = """recordings as (
  select concat(conv_id, '_', turn) as id, concat(conv_id, '/', turn, '.m4a') as audio_path,
         case when turn = 0 then '' else text end as transcript, text as english_translation,
         concat('d', length(text) % 3) as dialect, concat('P-', conv_id) as participant_id
  from conversations)"""
AUDIO = f"""{NAMED}, audio as (
  select stem, concat('AUDIO/', stem, ending) as path
  from named, (values ('.wav'), ('.mp3')) e(ending)
  where lang <> 'es' and (ending = '.wav' or lang = 'fr'))"""
TEXTS = "texts as (select stem, text from named where lang <> 'de')"
SPOKEN = f"""pairs as (
  select concat(conv_id, '_', turn) as id, {norm('text')} as ref, {norm(misheard('text'))} as hyp
  from conversations where text <> '')"""
DOCS = f"""pairs as (
  select doc_id as id, {norm('text')} as ref, {norm(misheard('text'))} as hyp
  from documents where text <> '')"""

# Edit distance of word lists by anti-diagonals: one step of the recursion advances every pair.
WORD_EDITS = """
tokens as (
  select id, list_filter(string_split(ref, ' '), lambda w: w <> '') as rw,
         list_filter(string_split(hyp, ' '), lambda w: w <> '') as hw from pairs),
coded as (
  select id, len(rw)::int as n, len(hw)::int as m,
         list_transform(rw, lambda w: list_position(v, w)::int) as r,
         list_transform(hw, lambda w: list_position(v, w)::int) as h
  from (select *, list_distinct(list_concat(rw, hw)) as v from tokens)),
steps(id, k, before, now) as (
  select id, 0, list_transform(range(n + 1), lambda i: 1000000),
         list_transform(range(n + 1), lambda i: case when i = 0 then 0 else 1000000 end)
  from coded
  union all
  select s.id, s.k + 1, s.now, list_transform(range(c.n + 1), lambda i:
    case when s.k + 1 - i < 0 or s.k + 1 - i > c.m then 1000000
         when i = 0 then s.k + 1
         when i = s.k + 1 then i
         else least(s.now[i] + 1, s.now[i + 1] + 1,
                    s.before[i] + case when c.r[i] = c.h[s.k + 1 - i] then 0 else 1 end) end)
  from steps s join coded c on c.id = s.id where s.k < c.n + c.m),
word_edits as (
  select s.id, c.n, s.now[c.n + 1]::bigint as edits
  from steps s join coded c on c.id = s.id where s.k = c.n + c.m)"""
# Characters of a pair become single bytes, on which levenshtein works; a pair has far fewer
# than 127 distinct ones.
CHAR_EDITS = """
letters as (
  select id, string_split(ref, '') as r, string_split(hyp, '') as h,
         list_distinct(list_concat(string_split(ref, ''), string_split(hyp, ''))) as v,
         length(ref) as n from pairs),
char_edits as (
  select id, n, levenshtein(
    array_to_string(list_transform(r, lambda c: chr(list_position(v, c)::int)), ''),
    array_to_string(list_transform(h, lambda c: chr(list_position(v, c)::int)), ''))::bigint as edits
  from letters)"""


def coded(name: str, split: str) -> str:
    """Lists r and h of small integers, one per symbol, numbered within the pair."""
    def numbers(c):
        return f"list_transform({c}, lambda s: list_position(v, s)::bigint)"

    return f"""
{name} as (
  select id, {numbers('rs')} as r, {numbers('hs')} as h
  from (select *, list_distinct(list_concat(rs, hs)) as v
        from (select id, {split.format(x='ref')} as rs, {split.format(x='hyp')} as hs from pairs)))"""


def grams(kind: str, source: str, orders: int, base: int) -> str:
    """Clipped counts per order. An n-gram of codes below `base` is one integer."""
    def side(c):
        gram = " + ".join(
            f"case when n > {j} then {base**j}::bigint * {c}[i + {j}] else 0 end" for j in range(orders)
        )
        return f"""select id, n, unnest(list_transform(range(1, len({c}) - n + 2), lambda i: {gram})) as g
          from {source}, (select unnest(range(1, {orders + 1})) as n) o"""

    return f"""
{kind}_h as (select id, n, g, count(*) as c from ({side('h')}) group by all),
{kind}_r as (select id, n, g, count(*) as c from ({side('r')}) group by all),
{kind}_m as (
  select a.n, sum(least(a.c, b.c)) as m from {kind}_h a join {kind}_r b using (id, n, g) group by a.n),
{kind}_t as (
  select n, sum(greatest(len(h) - n + 1, 0)) as th, sum(greatest(len(r) - n + 1, 0)) as tr,
         sum(case when len(r) >= n then greatest(len(h) - n + 1, 0) else 0 end) as th_chrf
  from {source}, (select unnest(range(1, {orders + 1})) as n) o group by n),
{kind}_c as (
  select n, coalesce(m, 0)::double as m, th::double as th, tr::double as tr, th_chrf::double as th_chrf
  from {kind}_t left join {kind}_m using (n))"""


WORD_LISTS = coded("word_lists", "list_filter(string_split({x}, ' '), lambda w: w <> '')") + ","
CHAR_LISTS = coded("char_lists", "string_split(replace({x}, ' ', ''), '')") + ","
BLEU = (
    grams("bleu", "word_lists", 4, 32768)
    + """,
smoothed as (
  select *, case when m = 0
    then 100 / (pow(2, sum((m = 0)::int) over (order by n)) * th) else 100 * m / th end as p
  from (select * from bleu_c where th > 0)),
bleu_score as (
  select case when (select min(th) from bleu_c) = 0 or (select max(m) from bleu_c) = 0 then 0.0
    else exp(avg(ln(p))) * (select case when th >= tr then 1.0 else exp(1 - tr / th) end
                            from bleu_c where n = 1) end as bleu
  from smoothed)"""
)
CHRF = (
    CHAR_LISTS
    + grams("char", "char_lists", 6, 128)
    + ","
    + grams("word", "word_lists", 2, 32768)
    + """,
chrf_mean as (
  select avg(m / th_chrf) as p, avg(m / tr) as r
  from (select * from char_c union all select * from word_c) where th_chrf > 0 and tr > 0),
chrf_score as (
  select case when p + r > 0 then 100 * 5 * p * r / (4 * p + r) else 0.0 end as chrf from chrf_mean)"""
)
OVERLAP = """
shares as (
  select len(list_intersect(list_distinct(h), list_distinct(r)))::double / len(list_distinct(r)) as share
  from word_lists where len(r) > 0)"""
TOKENS = f"""tokens as (
  select vec_id // {TOKENS_PER_PAIR} as id, vec_id, vec_id % 2 as side,
         list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v
  from embeddings),
cosines as (
  select h.id, h.vec_id as hv, r.vec_id as rv, list_dot_product(h.v, r.v) as c
  from tokens h join tokens r on h.id = r.id and h.side = 0 and r.side = 1),
matched as (
  select id, coalesce(p, 0.0) as p, coalesce(q, 0.0) as q from (select distinct id from tokens)
  left join (select id, avg(c) as p from (select id, hv, max(c) as c from cosines group by 1, 2) group by id) using (id)
  left join (select id, avg(c) as q from (select id, rv, max(c) as c from cosines group by 1, 2) group by id) using (id)),
similarity as (
  select id, p, q, case when p + q <> 0 then 2 * p * q / (p + q) else 0.0 end as f1 from matched)"""
UNITS = f"""sequences as (
  select doc_id as id, list_transform({words(norm('text'))}, lambda w: length(w)) as units, lang as text
  from documents)"""
KNN = f"""{UNITS},
asked as (select id, units from sequences where id in (select doc_id from labels)),
known as (select id, units, text from sequences where id not in (select doc_id from labels)),
qu as (select id, unnest(units) as u, generate_subscripts(units, 1) as pos from asked),
tu as (select id, unnest(units) as u, generate_subscripts(units, 1) as pos from known),
hits as (
  select qu.id as query_id, tu.id as train_id, count(*) as n from qu join tu using (pos, u) group by 1, 2),
ranked as (
  select a.id as query_id, k.id as train_id, k.text, len(a.units) as num_units,
         case when least(len(a.units), len(k.units)) = 0 then 0.0
              else coalesce(n, 0)::double / least(len(a.units), len(k.units)) end as similarity,
         row_number() over (partition by a.id order by similarity desc, k.id desc) as rank
  from asked a cross join known k left join hits h on h.query_id = a.id and h.train_id = k.id)"""
REFERENCES = (
    "refs as (select doc_id as id, upper(lang) as text from documents "
    "where doc_id in (select doc_id from labels where quality = 1))"
)
UNIT_CODE = " ".join(f"when '{name}' then {code}" for code, name in enumerate(UNIT_OF_EVENT))
SCORED = (
    "scored as (select event_id as id, (event_id % 101) / 100.0::double as confidence, "
    "event_id % 3 = 0 as correct, value from events)"
)
QUALITY = (
    "case when {x} < 10 then 'Poor' when {x} < 20 then 'Fair' when {x} < 30 then 'Good' "
    "else 'Excellent' end"
)
TIER = "case when confidence >= 0.9::double then 'high' when confidence >= 0.7::double then 'medium' else 'low' end"
LABELLED = f"""labelled as (
  select id, case when (id // {BATCH_SIZE}) % 2 = 0
    then list_concat([{BOS}], list_transform(units, lambda u: u + {BOS + 1}))
    else list_transform(units, lambda u: u + {BOS + 1}) end as labels
  from sequences)"""

SQL: dict[str, str] = {
    "scan_recordings": f"with {RECORDINGS} select * from recordings",
    "complete_rows": f"""with {RECORDINGS} select * from recordings
      where coalesce(audio_path, '') <> '' and coalesce(transcript, '') <> ''
        and coalesce(english_translation, '') <> ''""",
    "missing_items": f"""with {AUDIO} select path, stem from audio
      where path not in (select path from audio where suffix(path, '.wav'))""",
    "conform_examples": f"""with {RECORDINGS}
      select id, concat('cache/audio/', audio_path) as audio, transcript, english_translation, dialect,
             participant_id, null::varchar as age_group, null::varchar as gender from recordings""",
    "non_empty_text": f"""with blanks as (
        select doc_id, case lang when 'de' then '' when 'es' then '   ' when 'en' then text end as text
        from documents)
      select doc_id, text from blanks where not ({blank('text')})""",
    "file_stem": f"with {NAMED} select concat('AUDIO/', stem, '.wav') as path, stem, stem as unit_stem from named",
    "participant_id": f"with {NAMED} select stem, {SPEAKER} as participant_id from named",
    "normalize_text": f"select doc_id, {norm('text')} as normalized from documents",
    "pair_by_stem": f"""with {AUDIO}, {TEXTS}
      select stem, path, length(text)::int as chars from audio join texts using (stem)""",
    "fill_cache": f"with {AUDIO} select path, md5(path) as digest, ends_with(path, '.wav') as early from audio",
    "pair_first_audio": f"""with {AUDIO}, {TEXTS}
      select stem, min(path) as path from texts join audio using (stem) group by stem""",
    "corpus_tree_pairs": f"""with {NAMED}, hidden as (
        select concat(case doc_id % 5 when 0 then '_' when 1 then '.' else '' end, stem) as stem, {strip('text')} as text
        from named where lang <> 'es')
      select stem, text, concat(stem, '.wav') as audio from hidden where text <> ''""",
    "pair_coverage": f"""with {AUDIO}, {TEXTS}
      select count(t.stem) as matched, count(*) as total, count(t.stem) * 100 / count(*)::double as share
      from audio a left join (select distinct stem from texts) t using (stem)""",
    "participant_lookup": f"""with {NAMED},
      noted as (
        select concat('P-', source, '-', lang) as participant_id,
               case when n_chars > 2000 then null else lang end as dialect,
               case when n_chars > 1000 then '30-45' else '18-30' end as age_group,
               case when lang = 'en' then 'f' else 'm' end as gender,
               row_number() over (partition by source, lang order by doc_id desc) as latest
        from documents where doc_id in (select doc_id from labels where toxic = 1))
      select n.stem, {SPEAKER} as participant_id, dialect, age_group, gender
      from named n left join noted m on m.participant_id = {SPEAKER} and latest = 1""",
    "union_sources": f"""with {RECORDINGS}, {NAMED}
      select id, audio_path as audio, transcript, english_translation, dialect, participant_id,
             null::varchar as age_group, null::varchar as gender from recordings
      union all
      select stem, concat('train/AUDIO/', stem, '.wav'), null, text, null, {SPEAKER}, null, null
      from named where doc_id in (select doc_id from labels)""",
    "nth_item": "select doc_id, lang, source from documents order by doc_id limit 1 offset 7",
    "split_exact": """select doc_id,
        case when row_number() over (order by md5(concat(doc_id, ':42')), doc_id::varchar)
               <= floor(0.1 * count(*) over ()) then 'validation' else 'train' end as split
      from documents""",
    "vocabulary": f"""select word, count(*) as count,
        (row_number() over (order by count(*) desc, word))::int as word_id
      from (select unnest({words(norm('text'))}) as word from documents) group by word""",
    "encode_labels": f"""with lists as (select doc_id as id, {words(norm('text'))} as w from documents),
      tokens as (select id, unnest(w) as word, generate_subscripts(w, 1) as pos from lists),
      vocab as (select word, row_number() over (order by count(*) desc, word) as word_id
                from tokens group by word),
      coded as (select id, string_agg(word_id::varchar, ' ' order by pos) as joined
                from tokens join vocab using (word) group by id)
      select l.id, len(w)::int as n, md5(coalesce(joined, '')) as labels from lists l left join coded using (id)""",
    "encode_labels_joined": f"""with lists as (select doc_id as id, {words(norm('text'))} as w from documents),
      tokens as (select id, unnest(w) as word, generate_subscripts(w, 1) as pos from lists),
      vocab as (select word, row_number() over (order by count(*) desc, word) as word_id
                from tokens group by word),
      coded as (select id, string_agg(word_id::varchar, ' ' order by pos) as joined
                from tokens join vocab using (word) group by id)
      select l.id, len(w)::int as n, md5(coalesce(joined, '')) as labels from lists l left join coded using (id)""",
    "pad_labels": f"""with {UNITS}, {LABELLED},
      placed as (select *, (row_number() over (order by id) - 1) // {BATCH_SIZE} as batch from labelled),
      shaped as (select *, max(len(labels)) over (partition by batch) as width,
                        bool_and(coalesce(labels[1] = {BOS}, false)) over (partition by batch) as cut from placed),
      padded as (select batch, id, case when cut then list_resize(labels, width, -100)[2:]
                                        else list_resize(labels, width, -100) end as labels from shaped)
      select batch, id, len(labels)::int as width, {digest('labels')} as labels from padded""",
    "corpus_wer": f"""with recursive {SPOKEN}, {WORD_EDITS}
      select sum(edits)::bigint as word_edits, sum(n)::bigint as ref_words, sum(edits) / sum(n)::double as wer
      from word_edits""",
    "corpus_cer": f"""with {SPOKEN}, {CHAR_EDITS}
      select sum(edits)::bigint as char_edits, sum(n)::bigint as ref_chars, sum(edits) / sum(n)::double as cer
      from char_edits""",
    "sample_scores": f"""with recursive {SPOKEN}, {WORD_EDITS}, {CHAR_EDITS}
      select p.id, p.ref as reference_normalized, p.hyp as hypothesis_normalized,
             round(w.edits / nullif(w.n, 0)::double * 100, 2) as wer_pct,
             round(c.edits / nullif(c.n, 0)::double * 100, 2) as cer_pct
      from pairs p join word_edits w using (id) join char_edits c using (id)""",
    "reply_cer": f"""with {REPLIES}, pairs as (
        select id, {norm('reference')} as ref, {norm('hypothesis')} as hyp from replies
        where error is null and reference <> ''), {CHAR_EDITS}
      select sum(edits)::bigint as char_edits, sum(n)::bigint as ref_chars, sum(edits) / sum(n)::double as cer
      from char_edits""",
    "corpus_bleu": f"""with {DOCS}, {WORD_LISTS} {BLEU}
      select (select th from bleu_c where n = 1)::bigint as hyp_len,
             (select tr from bleu_c where n = 1)::bigint as ref_len,
             {', '.join(f"(select m from bleu_c where n = {n})::bigint as match_{n}" for n in range(1, 5))},
             {', '.join(f"(select th from bleu_c where n = {n})::bigint as total_{n}" for n in range(1, 5))},
             round(bleu, 6) as bleu from bleu_score""",
    "corpus_chrf": f"with {DOCS}, {WORD_LISTS} {CHRF} select round(chrf, 6) as chrf from chrf_score",
    "word_overlap": f"""with {DOCS}, {WORD_LISTS} {OVERLAP}
      select round(coalesce(avg(share) * 100, 0.0), 6) as word_overlap from shares""",
    "length_stats": f"""with {DOCS}, {WORD_LISTS}
      means as (select avg(len(h)) as mh, avg(len(r)) as mr from word_lists)
      select round(mh, 6) as mean_hypothesis_words, round(mr, 6) as mean_reference_words,
             round(mh / mr, 6) as length_ratio from means""",
    "valid_pairs": f"""with {REPLIES} select id, reference, hypothesis from replies
      where not ({blank('reference')}) and not ({blank('hypothesis')})""",
    "failed_counts": f"""with {REPLIES}
      select count(*) filter (reference <> '' and error is null) as processed,
             count(*) filter (reference <> '' and error is not null) as failed,
             count(*) filter (coalesce(reference, '') = '') as skipped from replies""",
    "quality_bands": f"select event_id as id, {QUALITY.format(x='value')} as quality from events",
    "embedding_score": f"""with {TOKENS}
      select id, round(p, 6) as precision, round(q, 6) as recall, round(f1, 6) as f1 from similarity""",
    "eval_summary": f"""with recursive {SPOKEN}, {WORD_EDITS}, {CHAR_EDITS}, {WORD_LISTS} {BLEU}, {CHRF}, {OVERLAP},
      {TOKENS.replace('tokens', 'vectors')},
      rates as (
        select (select sum(edits) / sum(n)::double from word_edits) as w,
               (select sum(edits) / sum(n)::double from char_edits) as e)
      select (select count(*) from pairs) as total_samples, round(bleu, 2) as bleu, round(chrf, 2) as chrf,
             round((select avg(f1) from conversations c join similarity s on s.id = c.conv_id
                     where not {blank('c.text')} and not {blank(misheard('c.text'))}), 4) as bertscore_f1,
             round(w * 100, 2) as wer_pct, round(e * 100, 2) as cer_pct,
             round((1 - w) * 100, 2) as word_accuracy_pct,
             round((select avg(share) * 100 from shares), 2) as word_overlap_pct,
             {QUALITY.format(x='bleu')} as quality
      from rates, bleu_score, chrf_score""",
    "predict_and_evaluate": f"""with recursive pairs as (
        select concat(conv_id, '_', turn) as id, {norm('text')} as ref, {norm("replace(text, 'th', 'z')")} as hyp
        from conversations where text <> '' and not contains(text, 'sch')),
      {WORD_EDITS}, {CHAR_EDITS}, {WORD_LISTS} {BLEU}, {CHRF}, {OVERLAP},
      rates as (
        select (select sum(edits) / sum(n)::double from word_edits) as w,
               (select sum(edits) / sum(n)::double from char_edits) as e)
      select (select count(*) from pairs) as total_samples, round(bleu, 2) as bleu, round(chrf, 2) as chrf,
             0.0::double as bertscore_f1, round(w * 100, 2) as wer_pct, round(e * 100, 2) as cer_pct,
             round((1 - w) * 100, 2) as word_accuracy_pct,
             round((select avg(share) * 100 from shares), 2) as word_overlap_pct,
             {QUALITY.format(x='bleu')} as quality,
             (select count(*) from conversations where text <> '' and not contains(text, 'sch')) as processed,
             (select count(*) from conversations where text <> '' and contains(text, 'sch')) as failed, 0::bigint as skipped
      from rates, bleu_score, chrf_score""",
    "first_samples": f"""with recursive {SPOKEN}, {WORD_EDITS}, {CHAR_EDITS}
      select p.id, p.ref as reference_normalized, p.hyp as hypothesis_normalized,
             round(w.edits / nullif(w.n, 0)::double * 100, 2) as wer_pct,
             round(c.edits / nullif(c.n, 0)::double * 100, 2) as cer_pct
      from pairs p join word_edits w using (id) join char_edits c using (id) order by p.id limit 10""",
    "retrieval_results": f"""with {KNN}, {REFERENCES}
      select k.query_id as file, coalesce(r.text, 'N/A') as reference, k.text as translation, round(similarity, 9) as confidence,
             coalesce(lower(trim(k.text)) = lower(trim(coalesce(r.text, 'N/A'))), false) as correct, num_units::int as num_units
      from ranked k left join refs r on r.id = k.query_id where k.rank = 1""",
    "retrieval_details": f"""with {KNN}, {REFERENCES}
      select k.query_id as file, coalesce(r.text, 'N/A') as reference, k.rank::int as rank, train_id, k.text, round(similarity, 9) as similarity
      from ranked k left join refs r on r.id = k.query_id where k.rank <= 5""",
    "fit_codebook": "select 10::bigint as units_used, count(*) as frames, true as no_dearer from embeddings",
    "audio_conform": """select vec_id::varchar as id, 16000 as rate, 2 * len(embedding) as n, 2 as channels_in, 8000 as rate_in,
        null::varchar as error, md5(array_to_string(list_transform(embedding,
          lambda x: trunc(greatest(-1, least(1, x::double)) * 32767)::int), ' ')) as heard from embeddings""",
    "ingest_examples": f"""with {RECORDINGS}, {AUDIO}, {TEXTS},
      noted as (
        select concat('P-', source, '-', lang) as participant_id,
               case when n_chars > 2000 then null else lang end as dialect,
               case when n_chars > 1000 then '30-45' else '18-30' end as age_group,
               case when lang = 'en' then 'f' else 'm' end as gender,
               row_number() over (partition by source, lang order by doc_id desc) as latest
        from documents where doc_id in (select doc_id from labels where toxic = 1)),
      paired as (
        select stem, text, min(path) as path from texts join audio using (stem) where not {blank('text')} group by stem, text)
      select id, audio_path as audio, transcript, english_translation, dialect, participant_id,
             null::varchar as age_group, null::varchar as gender from recordings
      union all
      select stem, path, null, text, dialect, {SPEAKER}, age_group, gender
      from paired left join noted m on m.participant_id = {SPEAKER} and latest = 1""",
    "batch_predict": f"""select conv_id, turn,
        case when not contains(text, 'sch') then {strip("replace(text, 'th', 'z')")} end as hypothesis,
        case when contains(text, 'sch') then 'ValueError: not a language of this model' end as error from conversations""",
    "units_scan": f"""with {UNITS}
      select id, len(units)::int as n, {digest('units')} as units, text from sequences""",
    "unit_stats": f"""with {UNITS} select count(*) as examples, round(avg(len(units)), 6) as mean_units
      from sequences where id not in (select doc_id from labels)""",
    "unit_prefix": f"""with {UNITS} select id, {', '.join(
        f"array_to_string(units[1:{n}], ' ') as first_{n}" for n in (10, 20, 30))} from sequences""",
    "unit_text_roundtrip": f"""with {UNITS}, joined as (
        select id, array_to_string(units, ' ') as text from sequences)
      select id, md5(text) as text, {digest(
        "list_filter(string_split(replace(text, ' 7 ', ' <unk> '), ' '), lambda t: regexp_full_match(t, '[0-9]+'))")} as units
      from joined""",
    "unit_similarity": f"""with {REPLIES}, lists as (
        select id, list_transform({words(norm('reference'))}, lambda w: length(w)) as a,
               list_transform({words(norm('hypothesis'))}, lambda w: length(w)) as b
        from replies where error is null)
      select id, round(case when least(len(a), len(b)) = 0 then 0.0 else
        list_sum(list_transform(range(1, least(len(a), len(b)) + 1),
          lambda i: case when a[i] = b[i] then 1 else 0 end))::double / least(len(a), len(b)) end, 9) as similarity
      from lists""",
    "knn_topk": f"""with {KNN} select query_id, rank::int as rank, train_id, text,
        round(similarity, 9) as similarity from ranked where rank <= 3""",
    "knn_translate": f"""with {KNN} select query_id as id, num_units::int as num_units, text as translation,
        round(similarity, 9) as confidence from ranked where rank = 1""",
    "knn_indexed": f"""with {KNN} select query_id as id, num_units::int as num_units, text as translation,
        round(similarity, 9) as confidence from ranked where rank = 1""",
    "reference_default": f"""with {REFERENCES}
      select l.doc_id as id, coalesce(r.text, 'N/A') as reference
      from labels l left join refs r on r.id = l.doc_id""",
    "exact_match": f"""with {KNN}, {REFERENCES},
      judged as (
        select lower(trim(k.text)) = lower(trim(coalesce(r.text, 'N/A'))) as correct
        from ranked k left join refs r on r.id = k.query_id where k.rank = 1)
      select count(*) as total, count(*) filter (correct) as correct_count,
             round(count(*) filter (correct) * 100 / count(*)::double, 6) as accuracy from judged""",
    "retrieval_nulls": f"""with {KNN}, {REFERENCES},
      results as (
        select k.query_id as id, case when k.query_id % 3 > 0 then k.text end as translation,
               case when k.query_id % 5 > 0 then round(similarity, 9) end as confidence, coalesce(r.text, 'N/A') as reference
        from ranked k left join refs r on r.id = k.query_id where k.rank = 1),
      judged as (
        select id, confidence, coalesce(lower(trim(translation)) = lower(trim(reference)), false) as correct from results)
      select correct, row_number() over (partition by correct order by confidence desc nulls last, id) - 1 as rank,
             confidence, id, round(count(*) over (partition by correct) * 100 / count(*) over ()::double, 6) as share
      from judged""",
    "confidence_stats": f"""with {SCORED}
      select round(avg(confidence) * 100, 6) as mean_confidence, round(min(confidence) * 100, 6) as min_confidence,
             round(max(confidence) * 100, 6) as max_confidence from scored""",
    "confidence_buckets": f"""with {SCORED}, buckets as (
        select i::int as bucket, ((i + 5) / 10.0)::double as low, ((i + 6) / 10.0)::double as high
        from range(5) t(i))
      select bucket, low, high, count(id) as count,
             round(case when count(id) = 0 then 0.0
                        else count(id) filter (correct) * 100 / count(id)::double end, 6) as accuracy
      from buckets left join scored on confidence >= low and confidence < high group by all""",
    "confidence_hist": f"""with {SCORED}, extent as (
        select min(confidence) as lo, max(confidence) as hi, avg(confidence) as mean from scored),
      counted as (
        select least(floor((confidence - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as n
        from scored, extent group by 1)
      select b.i::int as bin, round(lo + i * ((hi - lo) / 20), 6) as low,
             round(lo + (i + 1) * ((hi - lo) / 20), 6) as high, coalesce(n, 0) as count, round(mean, 6) as mean
      from range(20) b(i) cross join extent left join counted on bin = i""",
    "confidence_tiers": f"with {SCORED} select {TIER} as tier, count(*) as count from scored group by 1",
    "confidence_rank": f"""with {SCORED}
      select correct, row_number() over (partition by correct order by confidence desc, id) - 1 as rank,
             confidence, id from scored""",
    "correct_share": f"""with {SCORED} select correct, count(*) as count,
        round(count(*) * 100 / (select count(*) from scored)::double, 6) as share from scored group by correct""",
    "first_n_per_tier": f"""with {SCORED}, tiers as (select {TIER} as tier, * from scored),
      placed as (select *, row_number() over (partition by tier order by id) as place from tiers)
      select tier, place::int as place, id, confidence, correct from placed where place <= 3""",
    "unit_runs": f"""with stream as (
        select user_id, ts, event_id, case event_type {UNIT_CODE} end as unit from events),
      marked as (select *, case when lag(unit) over w = unit then 0 else 1 end as starts
                 from stream window w as (partition by user_id order by ts, event_id)),
      numbered as (select *, sum(starts) over (partition by user_id order by ts, event_id) as run from marked)
      select user_id, run::bigint as run, unit::int as unit, count(*) as duration
      from numbered group by user_id, run, unit""",
    "unit_dedupe": f"""with {UNITS},
      frames as (select id, unnest(units) as u, generate_subscripts(units, 1) as pos from sequences),
      marked as (select *, case when lag(u) over (partition by id order by pos) = u then 0 else 1 end as starts from frames),
      runs as (select *, sum(starts) over (partition by id order by pos) as run from marked),
      sizes as (select id, run, any_value(u) as u, count(*) as n from runs group by id, run),
      lists as (select id, string_agg(u::varchar, ' ' order by run) as u, string_agg(n::varchar, ' ' order by run) as n
                from sizes group by id)
      select s.id, md5(coalesce(l.u, '')) as units, md5(coalesce(l.n, '')) as durations
      from sequences s left join lists l using (id)""",
    "assign_units": """with centres as (
        select label as unit, arg_min(embedding, vec_id)::double[] as c from embeddings group by label),
      measured as (
        select vec_id, unit,
          list_sum(list_transform(list_zip(embedding::double[], c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance
        from embeddings cross join centres),
      ranked as (select *, row_number() over (partition by vec_id order by round(distance, 9), unit) as place from measured)
      select vec_id, unit, round(distance, 6) as distance from ranked where place = 1""",
    "corpus_stats": f"""with clips as (
        select n_chars * 100 / 16000::double as s, len({words(norm('text'))}) as w from documents)
      select round(min(s), 6) as min_seconds, round(max(s), 6) as max_seconds, round(avg(s), 6) as mean_seconds,
             min(w)::int as min_words, max(w)::int as max_words, round(avg(w), 6) as mean_words from clips""",
}
