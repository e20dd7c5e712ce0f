"""Static dictionaries: property tags, named properties, property-set ids, media types.

The standard tags that mail readers meet are built in. The published list is longer; the
rest of it (``PUBLISHED``), or tags of a vendor's own, join them as a parameter (``tags``), and the substitution that
decodes stores, a table of 256 bytes, is a parameter too (``substitution``).
"""

from __future__ import annotations

from collections.abc import Iterable

#: Standard property tags by code, as code, name (without its ``pr_``) and kind.
_TAGS = """
0002 alternate_recipient_allowed boolean
0004 auto_forward_comment tstring
000F deferred_delivery_time systime
0010 deliver_time systime
0015 expiry_time systime
0017 importance long
001A message_class tstring
0023 originator_delivery_report_requested boolean
0026 priority long
0029 read_receipt_requested boolean
002A receipt_time systime
0030 reply_time systime
0036 sensitivity long
0037 subject tstring
0039 client_submit_time systime
003B sent_representing_search_key binary
003D subject_prefix tstring
003F received_by_entryid binary
0040 received_by_name tstring
0041 sent_representing_entryid binary
0042 sent_representing_name tstring
0043 sent_representing_addrtype tstring
0044 sent_representing_email_address tstring
0045 original_sender_entryid binary
0046 original_sender_name tstring
0047 original_sender_search_key binary
0048 original_sent_representing_entryid binary
0049 original_sent_representing_name tstring
004A original_sent_representing_search_key binary
004B start_date systime
004C end_date systime
004D owner_appt_id long
004E response_requested boolean
0050 reply_recipient_entries binary
0051 reply_recipient_names tstring
0052 received_by_search_key binary
0055 original_sender_addrtype tstring
0056 original_sender_email_address tstring
0057 original_sent_representing_addrtype tstring
0058 original_sent_representing_email_address tstring
0059 conversation_topic tstring
005A conversation_index binary
005B original_display_bcc tstring
005C original_display_cc tstring
005D original_display_to tstring
005E received_by_addrtype tstring
005F received_by_email_address tstring
0060 received_representing_addrtype tstring
0061 received_representing_email_address tstring
0064 original_submit_time systime
0C15 recipient_type long
0C17 reply_requested boolean
0C19 sender_entryid binary
0C1A sender_name tstring
0C1D sender_search_key binary
0C1E sender_addrtype tstring
0C1F sender_email_address tstring
0E01 delete_after_submit boolean
0E02 display_bcc tstring
0E03 display_cc tstring
0E04 display_to tstring
0E06 message_delivery_time systime
0E07 message_flags long
0E08 message_size long
0E09 parent_entryid binary
0E0A sentmail_entryid binary
0E12 message_recipients object
0E13 message_attachments object
0E17 message_status long
0E1B hasattach boolean
0E1D normalized_subject tstring
0E1F rtf_in_sync boolean
0E20 attach_size long
0E21 attach_num long
0E62 url_comp_name_set boolean
0E79 trust_sender long
0FF4 access long
0FF7 access_level long
0FF9 record_key binary
0FFE object_type long
0FFF entryid binary
1000 body tstring
1001 report_text tstring
1006 rtf_sync_body_crc long
1007 rtf_sync_body_count long
1008 rtf_sync_body_tag tstring
1009 rtf_compressed binary
1010 rtf_sync_prefix_count long
1011 rtf_sync_trailing_count long
1013 body_html binary
1035 internet_message_id tstring
1039 internet_references tstring
1042 in_reply_to_id tstring
1043 list_help tstring
1044 list_subscribe tstring
1045 list_unsubscribe tstring
1046 internet_return_path tstring
3001 display_name tstring
3002 addrtype tstring
3003 email_address tstring
3004 comment tstring
3005 depth long
3007 creation_time systime
3008 last_modification_time systime
300B search_key binary
35E0 ipm_subtree_entryid binary
35E2 ipm_outbox_entryid binary
35E3 ipm_wastebasket_entryid binary
35E4 ipm_sentmail_entryid binary
3600 container_flags long
3601 folder_type long
3602 content_count long
3603 content_unread long
3610 subfolders boolean
3613 container_class tstring
3701 attach_data_bin binary
3703 attach_extension tstring
3704 attach_filename tstring
3705 attach_method long
3707 attach_long_filename tstring
3708 attach_pathname tstring
370B rendering_position long
370E attach_mime_tag tstring
3710 attach_mime_sequence long
3712 attach_content_id tstring
3713 attach_content_location tstring
3714 attach_long_pathname tstring
3716 attach_content_disposition tstring
3900 display_type long
39FE smtp_address tstring
3A00 account tstring
3A02 callback_telephone_number tstring
3A06 given_name tstring
3A08 business_telephone_number tstring
3A09 home_telephone_number tstring
3A0A initials tstring
3A0C language tstring
3A0D location tstring
3A11 surname tstring
3A15 postal_address tstring
3A16 company_name tstring
3A17 title tstring
3A18 department_name tstring
3A19 office_location tstring
3A1A primary_telephone_number tstring
3A1B business2_telephone_number tstring
3A1C mobile_telephone_number tstring
3A1D radio_telephone_number tstring
3A1E car_telephone_number tstring
3A1F other_telephone_number tstring
3A20 transmittable_display_name tstring
3A21 pager_telephone_number tstring
3A22 user_certificate binary
3A23 primary_fax_number tstring
3A24 business_fax_number tstring
3A25 home_fax_number tstring
3A26 country tstring
3A27 locality tstring
3A28 state_or_province tstring
3A29 street_address tstring
3A2A postal_code tstring
3A2B post_office_box tstring
3A2F assistant_telephone_number tstring
3A30 home2_telephone_number tstring
3A40 send_rich_info boolean
3A44 middle_name tstring
3A45 display_name_prefix tstring
3A46 profession tstring
3A4F nickname tstring
3A51 personal_home_page tstring
3A70 user_x509_certificate binary
3FDE internet_cpid long
3FF1 message_locale_id long
3FFD message_codepage long
403E org_email_addr tstring
5909 smtp_address tstring
5D01 sender_smtp_address tstring
5D02 sent_representing_smtp_address tstring
5FDE recipient_order long
5FF6 recipient_display_name tstring
5FF7 recipient_entryid binary
5FFF recipient_flags long
65E0 source_key binary
65E2 change_key binary
65E3 predecessor_change_list binary
6619 user_entryid binary
661B mailbox_owner_entryid binary
6620 schedule_folder_entryid binary
6622 ipmdrafts_entryid binary
6627 additional_ren_entryids binary
6645 ipm_appointment_entryid binary
6646 ipm_contact_entryid binary
6647 ipm_journal_entryid binary
6648 ipm_note_entryid binary
6649 ipm_task_entryid binary
66A1 locale_id long
6800 pst_password long
"""

#: The rest of the published list, in the same form; ``PUBLISHED`` has them as ``tags``.
_MORE_TAGS = """
0001 acknowledgement_mode long
0003 authorizing_users binary
0005 auto_forwarded boolean
0006 content_confidentiality_algorithm_id binary
0007 content_correlator binary
0008 content_identifier tstring
0009 content_length long
000A content_return_requested boolean
000B conversation_key binary
000C conversion_eits binary
000D conversion_with_loss_prohibited boolean
000E converted_eits binary
0011 discard_reason long
0012 disclosure_of_recipients boolean
0013 dl_expansion_history binary
0014 dl_expansion_prohibited boolean
0016 implicit_conversion_prohibited boolean
0018 ipm_id binary
0019 latest_delivery_time systime
001B message_delivery_id binary
001E message_security_label binary
001F obsoleted_ipms binary
0020 originally_intended_recipient_name binary
0021 original_eits binary
0022 originator_certificate binary
0024 originator_return_address binary
0025 parent_key binary
0027 origin_check binary
0028 proof_of_delivery_requested boolean
002B recipient_reassignment_prohibited boolean
002C redirection_history binary
002D related_ipms binary
002E original_sensitivity long
002F languages tstring
0031 report_tag binary
0032 report_disposition tstring
0033 report_disposition_mode tstring
0034 originator_non_delivery_report_requested boolean
003A report_name tstring
0053 received_by_entryid2 binary
0054 received_by_name2 tstring
0062 original_author_addrtype tstring
0063 original_author_email_address tstring
0065 reply_recipient_entries2 binary
0070 conversation_topic2 tstring
0071 conversation_index2 binary
0072 original_display_bcc2 tstring
0073 original_display_cc2 tstring
0074 original_display_to2 tstring
0075 received_by_addrtype2 tstring
0076 received_by_email_address2 tstring
0C06 non_receipt_notification_requested boolean
0C1B supplementary_info tstring
0E0F responsibility boolean
0E28 primary_send_acct tstring
0E29 next_send_acct tstring
1014 body_html2 tstring
3010 target_entryid binary
35E5 views_entryid binary
35E6 common_views_entryid binary
35E7 finder_entryid binary
3702 attach_encoding binary
3709 attach_rendering binary
370A attach_tag binary
3A05 generation tstring
3A0B keyword tstring
3A0F mhs_common_name tstring
3A10 organizational_id_number tstring
3A12 original_entryid binary
3A13 original_display_name tstring
3A2D telex_number tstring
3A2E isdn_number tstring
3A48 spouse_name tstring
3A57 company_main_phone_number tstring
3A58 childrens_names tstring
3D01 ab_default_dir binary
5902 internet_content binary
6000 recipient_trackstatus long
6001 recipient_trackstatus_time systime
6635 pst_hidden_count long
6636 pst_hidden_unread long
6638 folder_webviewinfo binary
67F2 ltp_row_id long
67F3 ltp_row_ver long
"""

#: Property sets and their names.
_SETS = """
00020328-0000-0000-C000-000000000046 ps_mapi
00020329-0000-0000-C000-000000000046 ps_public_strings
00062008-0000-0000-C000-000000000046 psetid_common
00062004-0000-0000-C000-000000000046 psetid_address
00062002-0000-0000-C000-000000000046 psetid_appointment
6ED8DA90-450B-101B-98DA-00AA003F1305 psetid_meeting
0006200A-0000-0000-C000-000000000046 psetid_log
41F28F13-83F4-4114-A584-EEDB5A6B0BFF psetid_messaging
0006200E-0000-0000-C000-000000000046 psetid_note
00062041-0000-0000-C000-000000000046 psetid_post_rss
00062003-0000-0000-C000-000000000046 psetid_task
4442858E-A9E3-4E80-B900-317A210CC15B psetid_unified_messaging
71035549-0739-4DCB-9163-00F0580DBBDF psetid_air_sync
00062040-0000-0000-C000-000000000046 psetid_sharing
96357F7F-59E1-47D0-99A7-46515C183B54 psetid_attachment
00020386-0000-0000-C000-000000000046 ps_internet_headers
"""

#: Named properties by property set, as code and name.
_NAMED = {
    "psetid_address": """
8005 file_under
8006 file_under_id
800E email1_display_name
800F email1_address_type
8010 email1_email_address
8014 email1_original_display_name
8015 email1_original_entryid
8023 email1_display_name_2
8045 email2_display_name
8046 email2_address_type
8047 email2_email_address
8053 email2_original_display_name
8054 email2_original_entryid
8080 email3_display_name
8081 email3_address_type
8082 email3_email_address
8084 email3_original_display_name
8085 email3_original_entryid
80B2 home_address
80B8 work_address
80B9 other_address
80D8 internet_free_busy_address
""",
    "psetid_appointment": """
8201 appt_sequence
8205 busy_status
8208 location
820D appt_start_whole
820E appt_end_whole
8213 appt_duration
8214 appt_color
8215 appt_sub_type
8216 appt_state_flags
8217 response_status
8218 recurring
8223 is_recurring
8228 recurrence_type
8229 recurrence_pattern
8231 time_zone
8232 clip_start
8233 clip_end
8234 original_store_entryid
8235 all_day_event
8236 appt_message_class
""",
    "psetid_common": """
8501 reminder_delta
8502 reminder_time
8503 reminder_set
8506 private
8510 smart_no_attach
8514 sidebar_image
8516 common_start
8517 common_end
8520 task_mode
8530 companies
8535 billing
8539 contacts
8554 current_version
8560 reminder_signal_time
8580 internet_account_name
8581 internet_account_stamp
8582 use_tnef
""",
    "psetid_log": """
8700 log_type
8706 log_start
8707 log_duration
8708 log_end
""",
    "psetid_task": """
8101 task_status
8102 percent_complete
8103 team_task
8104 task_start_date
8105 task_due_date
810F task_date_completed
8110 task_actual_effort
8111 task_estimated_effort
811C task_complete
811F task_owner
8121 task_delegator
8126 task_is_recurring
8129 task_ownership
""",
    "ps_internet_headers": """
0002 x_sharing_flavor
0003 x_sharing_local_type
""",
}

#: Media types by file extension.
MEDIA = {
    "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "xml": "application/xml",
    "pdf": "application/pdf", "zip": "application/zip", "png": "image/png", "gif": "image/gif", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "msg": "application/vnd.ms-outlook",
}
DEFAULT_MEDIA = "application/octet-stream"

#: Property type codes and their labels.
KINDS = {
    0x00: "pt_unspecified", 0x01: "pt_null", 0x02: "pt_short", 0x03: "pt_long", 0x04: "pt_float", 0x05: "pt_double", 0x06: "pt_currency",
    0x07: "pt_apptime", 0x0A: "pt_error", 0x0B: "pt_boolean", 0x0D: "pt_object", 0x14: "pt_int64", 0x1E: "pt_string8", 0x1F: "pt_unicode",
    0x40: "pt_systime", 0x48: "pt_clsid", 0x102: "pt_binary",
}
MULTI = 0x1000

#: Warning codes that decoders give.
WARNING_CODES = (
    "nameid_parse_failed", "property_parse_failed", "attachment_skipped", "malformed_header_line", "multipart_missing_boundary",
    "pst_index_parse_failed", "pst_descriptor_parse_failed", "pst_branch_loop_detected", "pst_substitution_missing", "nested_part_warning",
)


def guid_bytes(text: str) -> bytes:
    """16 bytes of ``8-4-4-4-12`` hex, the first three fields little-endian; braces may stand around it."""
    a, b, c, d, e = text.strip("{}").split("-")
    if [len(x) for x in (a, b, c, d, e)] != [8, 4, 4, 4, 12]:
        raise ValueError(f"not a GUID: {text!r}")
    return bytes.fromhex(a)[::-1] + bytes.fromhex(b)[::-1] + bytes.fromhex(c)[::-1] + bytes.fromhex(d + e)


def guid_text(raw: bytes) -> str:
    """``{8-4-4-4-12}`` in upper case."""
    if len(raw) != 16:
        raise ValueError("a GUID has 16 bytes")
    h = (raw[3::-1] + raw[5:3:-1] + raw[7:5:-1] + raw[8:]).hex().upper()
    return f"{{{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}}}"


def entries(block: str) -> list[tuple]:
    """(code, name, ...) of lines that begin with a hexadecimal code."""
    return [(int(x[0], 16), *x[1:]) for x in map(str.split, block.splitlines()) if x]


def merged(more: Iterable[tuple[int, str, str]] = ()) -> dict[int, tuple[str, str]]:
    """code -> (name, kind) in the order of codes: the built-in tags, under those of ``more`` (code, name, kind), names without their ``pr_``."""
    rows = {**{c: (n, k) for c, n, k in entries(_TAGS)}, **{c: (n, k) for c, n, k in more}}
    return {c: (f"pr_{n}", f"pt_{k}") for c, (n, k) in sorted(rows.items())}


#: Standard tags beyond those built in, for ``tags``; with them all 281 of the published list have names.
PUBLISHED = tuple(entries(_MORE_TAGS))


#: code -> (name, kind) of tags, name -> lowest code, and the 256 bytes that encoded stores are decoded by, as ``use`` set them in this process.
TAGS = merged()
TAG_CODES: dict[str, int] = {}
SUBSTITUTION: bytes | None = None


def use(tags: Iterable[tuple[int, str, str]] = (), substitution: bytes | None = None) -> None:
    """Work with more tags, and with a substitution, from here on; without arguments with what is built in."""
    global SUBSTITUTION
    if substitution is not None and len(substitution) != 256:
        raise ValueError("a substitution has 256 bytes")
    SUBSTITUTION = substitution
    found = merged(tags)
    TAGS.clear()
    TAGS.update(found)
    TAG_CODES.clear()
    for code, (name, _) in TAGS.items():
        TAG_CODES.setdefault(name, code)


use()
#: name -> bytes of a property set, and back.
SETS = {line.split()[1]: guid_bytes(line.split()[0]) for line in _SETS.strip().split("\n")}
SET_NAMES = {raw: name for name, raw in SETS.items()}
PS_MAPI, PS_PUBLIC_STRINGS = SETS["ps_mapi"], SETS["ps_public_strings"]
#: (code, property set) -> name of named properties.
NAMED = {(code, SETS[s]): name for s, block in _NAMED.items() for code, name in entries(block)}


def symbol(code: int | str, guid: bytes = PS_MAPI) -> str | None:
    """Name of a property; string codes and unknown ones have none."""
    if not isinstance(code, int):
        return None
    return TAGS.get(code, (None,))[0] if guid == PS_MAPI else NAMED.get((code, guid))


def key_text(code: int | str, guid: bytes = PS_MAPI) -> str:
    """A property key for people: its name, else the code in hex, with the property set if that isn't the standard one."""
    name = symbol(code, guid)
    if name:
        return name
    label = SET_NAMES.get(guid, "unknown")
    if not isinstance(code, int):
        return f'"{code}"@{label}'
    return f"{code:04x}" if guid == PS_MAPI else f"{code:04x}@{label}"


def kind_label(code: int) -> str:
    base = KINDS.get(code & 0x0FFF)
    if base is None:
        return "unknown"
    return f"pt_mv_{base[3:]}" if code & MULTI else base


def media_type(filename: str) -> str:
    stem, dot, ext = filename.rpartition("/")[2].rpartition(".")
    return MEDIA.get(ext.lower(), DEFAULT_MEDIA) if dot and stem else DEFAULT_MEDIA
